"""Named queries over the driver tables with their SQL twins."""

from flowsift.catalog import alerts, analytics, features, logs, streams  # noqa: F401
from flowsift.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
