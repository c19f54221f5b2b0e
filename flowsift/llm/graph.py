"""Connected components by minimum labels with pointer jumping; edges may come in any form and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node it is connected with) for all nodes of edges (a, b) of whole numbers.

    Every round takes the least label among neighbours and then that label's own label, so long chains
    shrink by halves. Rounds end when a round changes nothing; the count of changes alone reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    state = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                   .select(F.col("a").alias("node"), "label"))
    while True:
        label = state.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(label, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = state.join(least, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("near"))
        jump = state.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = stored(lower.join(jump, "near", "left").select(
            "node", "old", F.least("near", F.coalesce("far", "near")).alias("label")))
        state = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return state
