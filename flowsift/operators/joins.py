"""Joins to side tables whose size is measured, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 32
# rows of one key that a task holds
HOT_ROWS = 100_000


def lookup_join(rows: DataFrame, side: DataFrame, on: str, how: str = "left",
                max_rows: int = BROADCAST_ROWS, row_id: str | None = None) -> DataFrame:
    """Joins a side table that is unique in the key, safe for keys that hold many rows.

    At most max_rows + 1 rows of the side table are counted: a small one is broadcast. A
    larger one is joined by (key, salt): each row of a key with over HOT_ROWS rows takes one of SALTS
    copies of its key, so a hot key spreads over that many tasks; other keys are not copied. The result
    is the same either way.
    """
    small = side.limit(max_rows + 1).count() <= max_rows
    if small:
        return rows.join(F.broadcast(side), on, how)
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join: {how}")
    pick = F.xxhash64(row_id or F.struct(*rows.columns))
    # at most one row per HOT_ROWS rows
    hot = F.broadcast(rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(
        on, F.lit(True).alias("_hot")))
    salted = rows.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(pick, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    # counted as too large to broadcast, whatever the size of its files suggests
    return salted.join(_copies(side, hot, on).hint("merge"), [on, "_salt"], how).drop("_salt")


def _copies(side: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    """The side table with `_salt`: SALTS rows for a hot key, one for any other."""
    last = F.when(F.col("_hot"), SALTS - 1).otherwise(0)
    return side.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
