"""Merkle manifest of a table of documents: a tree of three per source, a tree of three over the sources.

A node is labelled with the interval [lo, hi) of the leaf ranks it covers, and keeps its children's intervals
with their digests. Intervals nest, so an ancestor is found by containment: nodes of a level have one width,
lo divided by that width is the bucket both sides of the join share, and the join asks for containment inside
the bucket. What a parent's interval covers besides a node's own, before it and after it, are the node's
siblings. Paths are attached from the roots downwards, a level per join, so each node meets its parent only.

Ranks come from a range partitioned sort: rows are numbered within their range, and ranges by their counts
per source. No source, however large, is in one task, and no key of any join has more than three rows on
the lower side, but for the subroots, of which there is one per source.

Defined results: rows of equal doc_id follow each other by digest; null ids come first, and count as an empty
text where a number is drawn from the id; repeated rows are leaves of their own; a null source is a source of
its own, before all others and apart from the empty one; an empty table has no rows and no root; other
columns are ignored. A table's rows may come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import stored, wide

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields, each with its length; `changed` stands in for columns."""
    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*map(part, FIELDS))


def _ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """Level 0 of a tree per `tree`: interval [lo, hi) of one rank, and the tree's number of leaves as `nodes`."""
    keys = ["tree", *order]
    # a drawn number parts rows that are equal in all keys, so they don't have to be in one range
    placed = stored(
        leaves.withColumn("draw", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(wide(leaves), *keys, "draw").sortWithinPartitions(*keys, "draw").drop("draw")
        .withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    # a row per range, and one more per tree
    runs = placed.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.select(
        "tree", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("nodes")))
    lo = F.col("before") + F.col("at") - F.col("first")
    return placed.join(runs, ["tree", "range"]).withColumns({"lo": lo, "hi": lo + 1}).drop(
        "at", "range", "first", "before")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees: tree, lo, hi, digest, children, nodes (of the tree in this level).

    A tree ends at the level where it has one node. `leaves` keeps its further columns.
    """
    levels = [stored(leaves)]
    most, width = levels[0].agg(F.max("nodes")).first()[0] or 0, 1
    while most > 1:
        width *= ARITY
        most = -(-most // ARITY)
        levels.append(stored(
            levels[-1].where("nodes > 1")
            .groupBy("tree", F.floor(F.col("lo") / width).alias("bucket"))
            .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"),
                 F.max("nodes").alias("nodes"))
            .select("tree", F.expr("children[0].lo").alias("lo"), F.expr("element_at(children, -1).hi").alias("hi"),
                    digest(F.array_join("children.digest", "")).alias("digest"), "children",
                    F.ceil(F.col("nodes") / ARITY).cast("bigint").alias("nodes"))))
    return levels


NO_PATH = "cast(array() as array<struct<before: string, after: string>>)"


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with `path`, their siblings from below up, and the columns of their tree's row in `tops`.

    tops: tree, path (how it goes on above the tree), further columns to hand down.
    """
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        own = nodes.where("nodes = 1").join(tops, "tree")
        if above is not None:
            width = ARITY ** (level + 1)
            inside = (F.col("lo") >= F.col("p.lo")) & (F.col("hi") <= F.col("p.hi"))
            parents = above.select(
                "tree", F.floor(F.col("lo") / width).alias("bucket"),
                F.struct("lo", "hi", "children", "path", *carried).alias("p"))
            below = nodes.where("nodes > 1").withColumn("bucket", F.floor(F.col("lo") / width)).join(
                parents, ["tree", "bucket"]).where(inside)
            # the parent's interval without the node's own
            rest = {"before": F.filter("p.children", lambda c: c["hi"] <= F.col("lo")),
                    "after": F.filter("p.children", lambda c: c["lo"] >= F.col("hi"))}
            step = F.struct(*(F.array_join(x["digest"], "").alias(name) for name, x in rest.items()))
            below = below.select(*nodes.columns, F.concat(F.array(step), "p.path").alias("path"),
                                 *(F.col(f"p.{c}").alias(c) for c in carried))
            own = own.select(*below.columns).union(below)
        above = own
    return above


def trees(docs: DataFrame, tampered: Column | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the trees of all sources (column `tree`: empty for a null source, else `s` and its name), and
    levels of the tree over their roots (its one `tree` is empty). Nodes have lo, hi, digest, children.

    The leaves have doc_id and, of another text given in `tampered`, the digest found_leaf.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    own = leaf()
    leaves = docs.select(
        source.alias("tree"), F.col("doc_id"), own.alias("digest"),
        (own if tampered is None else leaf(text=tampered)).alias("found_leaf"))
    of_sources = _levels(_ranked(leaves, "doc_id", "digest"))
    roots = [level.where("nodes = 1").select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
             for level in of_sources]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.union(more)
    return of_sources, _levels(_ranked(subroots, "source"))


def manifest(docs: DataFrame) -> DataFrame:
    """All nodes: tree (null: over the sources), level, lo, hi, digest."""
    of_sources, over = trees(docs)
    out = None
    for name, levels in (("tree", of_sources), (None, over)):
        for k, level in enumerate(levels):
            rows = level.select((F.col(name) if name else F.lit(None).cast("string")).alias("tree"),
                                F.lit(k).alias("level"), "lo", "hi", "digest")
            out = rows if out is None else out.union(rows)
    return out


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, found_leaf, subroot, root and path of every row: siblings before and after, from below up."""
    of_sources, over = trees(docs, tampered)
    last = over[-1].where("nodes = 1")
    # the root is one row
    top = last.select("tree", F.expr(NO_PATH).alias("path"), F.col("digest").alias("root"))
    tops = _paths(over, top).select(
        F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return _paths(of_sources, stored(tops)).select(
        "doc_id", F.col("digest").alias("leaf"), "found_leaf", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda at, step: digest(step["before"], at, step["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def without_newlines() -> Column:
    """The text without newlines where the crc of the id is even."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def verified_rows(docs: DataFrame) -> DataFrame:
    """Every row's proof, and whether its text without newlines (every second one's) still folds to the root."""
    found = proofs(docs, without_newlines()).withColumn("folded_root", folded(F.col("found_leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
