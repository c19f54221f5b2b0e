import pytest

from tests.llm.fixtures import stored_corpus


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    return stored_corpus(spark, tmp_path_factory)
