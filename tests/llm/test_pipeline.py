import zlib

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from flowsift.llm import queries
from tests.llm.fixtures import none
from tests.llm.test_copies import linked, removed


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = queries.table(spark, sf, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], sf)))
    return out


def test_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11)) and {"pipeline", *queries.QUERIES} <= set(entry_point.queries())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_toxic_documents_go(spark):
    """Held-out labels; the table has some forty toxic documents to learn from, in four languages."""
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    docs = corpus_pipeline.remove_toxic(spark, queries.table(spark, folder, "documents"), folder)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    held = [i for i in label if zlib.crc32(str(i).encode()) % 3 == 1]
    toxic, clean = [i for i in held if label[i] == 1], [i for i in held if label[i] == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert sum(i not in kept for i in toxic) >= 0.5 * len(toxic), (len(toxic), sum(i not in kept for i in toxic))


def test_one_of_each_class_stays(steps):
    docs = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert {r.doc_id for r in steps[2].collect()} == {c for _, c, _ in linked(docs)}


def test_repeated_passages_go(steps):
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    size = {i: n - gone for i, n, gone, _, _ in removed(before)}
    after = {r.doc_id: r.text for r in steps[3].collect()}
    assert all(size[i] <= len(t.encode()) <= size[i] + 12 for i, t in after.items())
    assert {i for i, n in size.items() if n} <= set(after)


def test_packed_documents_are_the_clean_ones(steps):
    assert {r.doc_id for r in steps[5].select("doc_id").collect()} == {r.doc_id for r in steps[4].collect()}
    assert steps[4].count() <= steps[3].count()


def test_awkward_and_empty_tables(spark, sf, corpus, tmp_path):
    names = [c for c in corpus.columns if c in corpus_pipeline.COLUMNS]
    none(spark).write.parquet(str(tmp_path / "none"))
    for docs in (corpus, spark.read.parquet(str(tmp_path / "none"))):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf))
            assert name == "best_fit_packing" or docs.columns == names


def test_run(spark, sf, steps):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf).select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[5].select(*key).collect()))
