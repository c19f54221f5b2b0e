"""Balanced label propagation: linked documents move into the same shard while shards stay even.

Documents with equal texts are linked through a hub per text. A linked document starts in a shard drawn
for its row. In each round a hub counts its documents per shard and names the one most of them are in, save
shards it fills by itself, in every second round among the shards with room only; documents in shards that hold fewer want to move there.
A wish is granted as far as it is matched by the opposite wish or finds room below the target's quota,
shared out among all that want to go there. Rounds go on until four in a row lessen the cut by less than
`GAIN` of it; texts whose rows have come together are carried no further. Which documents move is decided by a hash of the row, so no list of wishes is ever sorted or held. The quota lies below an even
share, or a little above an even share of the linked rows where these are nearly all: the cuts even out the
rest. Documents without links then fill each shard up. At the end all rows are laid out by
shard, linked ones in the middle of each shard's run, and the layout is cut into runs whose sizes differ
by one row at most, so a cut separates linked rows only where a hub outgrows a shard. All steps are joins
and aggregations; a hub that holds a large part of the rows is counted map-side, and laid out and joined
in salted cells.

Defined results: null texts have size 1 and the crc of an empty text and are linked with each other and
with empty ones; null ids and repeated rows are rows of their own; an empty table gives no rows; ties go
to the shard that comes first in an order drawn per hub, so many small hubs spread evenly.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import stored

# the part of an even share that linked rows may take
QUOTA = 0.97
# where linked rows need more: what a shard may hold above an even share of them
SLACK = 1.05
# a text that holds this part of a shard's quota gathers its other rows elsewhere
FILLED = 0.9
# rounds go on while four of them take away at least this part of the cut
GAIN = 0.05
# documents of one cell of the layout, about
CELL = 20_000
# a text that makes up more than one part in so many is joined by broadcast: at most as many texts
HEAVY = 1_000


def _drawn(*parts) -> Column:
    """A number from 0 to 1 that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def propagate(nodes: DataFrame, shards: int, quota: float, gain: float = GAIN, cell: int = CELL) -> DataFrame:
    """row, shard of linked rows (row, hub, linked: rows of the hub) after moves between shards of at most
    `quota` rows.

    The cut is the sum over rows of the part of their hub's rows that lie in other shards. Every move takes a
    row to a shard that holds at least as many rows of its hub, so the cut falls. Rounds of the two kinds take
    turns until four in a row take less than `gain` of the cut away, which bounds their number by the logarithm
    of the rows. Hubs that have come together in one shard are set aside and carried no further.
    """
    spark = nodes.sparkSession
    active = nodes.select(
        "row", "hub", "linked", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int").alias("shard"))
    together, placed, cuts = [], [0] * shards, []
    while True:
        counts = stored(active.groupBy("hub", "shard").agg(F.count("*").alias("n"), F.first("linked").alias("linked")))
        # one row per shard at most
        held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        cuts.append(counts.agg(F.sum(_apart())).first()[0] or 0.0)
        if not cuts[-1] or (len(cuts) > 4 and cuts[-5] - cuts[-1] < gain * cuts[-5]):
            break
        size = [placed[k] + held.get(k, 0) for k in range(shards)]
        room = F.element_at(F.array(*(F.lit(float(max(0, int(quota) - n))) for n in size)), F.col("shard") + 1)
        ranked = counts.withColumn("own", F.struct("n", F.xxhash64("hub", "shard").alias("draw"), "shard"))
        # all shards that the hub doesn't fill by itself, then those with room only: what can't get into a full
        # shard gathers elsewhere
        open_ = F.col("n") < F.lit(FILLED * quota) if len(cuts) % 2 else room > 0
        best = ranked.groupBy("hub").agg(F.max(F.when(open_, F.col("own"))).alias("best"), F.count("*").alias("in"))
        wish = stored(ranked.join(best, "hub").where("in = 1 or own < best").select(
            "hub", "shard", "n", "linked", F.when(F.col("in") > 1, F.col("best.shard")).alias("target")))
        # a row per pair of shards at most
        wanted = {(r["shard"], r["target"]): r["n"] for r in wish.where("target is not null").groupBy(
            "shard", "target").agg(F.sum("n").alias("n")).collect()}
        shares = spark.createDataFrame(_shares(wanted, size, quota), "shard int, target int, share double")
        # rows of one hub and shard meet their grant in as many parts as they fill cells
        parts = F.ceil(F.col("linked") / cell).cast("int")
        grants = wish.join(F.broadcast(shares), ["shard", "target"], "left").where(
            "target is null or share > 0").select(
            "hub", "shard", "target", "share", F.col("target").isNull().alias("whole"),
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        moved = F.col("share").isNotNull() & (_drawn("row", F.lit(len(cuts))) < F.col("share"))
        after = stored(
            active.withColumn("salt", F.pmod(F.xxhash64("row"), parts).cast("int"))
            .join(grants, ["hub", "shard", "salt"], "left")
            .select("row", "hub", "linked", F.when(moved, F.col("target")).otherwise(F.col("shard")).alias("shard"),
                    F.coalesce("whole", F.lit(False)).alias("whole")))
        together.append(after.where("whole").select("row", "shard"))
        for r in wish.where("target is null").groupBy("shard").agg(F.sum("n").alias("n")).collect():
            placed[r["shard"]] += r["n"]
        active = after.where("not whole").drop("whole")
    every = active.select("row", "shard")
    for part in together:
        every = every.union(part)
    return every


def _shares(wanted: dict[tuple[int, int], int], size: list[int], quota: float) -> list[tuple[int, int, float]]:
    """The part of each wish (shard, target) that is granted: matched by the opposite one, or into free room."""
    matched = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    into = [sum(n - matched[p] for p, n in wanted.items() if p[1] == k) for k in range(len(size))]
    free = [min(1.0, max(0, int(quota) - n) / max(1, m)) for n, m in zip(size, into)]
    return [(a, b, (matched[a, b] + (n - matched[a, b]) * free[b]) / n) for (a, b), n in wanted.items()]


def _apart() -> Column:
    """Of `n` rows of a hub in one shard, the cut: each has the part of its hub's rows that lie elsewhere."""
    return F.col("n") * (F.col("linked") - F.col("n")) / F.col("linked")


def cut_links(placed: DataFrame) -> DataFrame:
    """linked, cut: how many rows (hub, shard) share their hub with others, and the cut, 0 to linked."""
    counts = placed.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    hubs = counts.groupBy("hub").agg(F.sum("n").alias("linked")).where("linked > 1")
    return counts.join(hubs, "hub").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(_apart()), F.lit(0.0)).alias("cut"))


def balanced_shards(docs: DataFrame, shards: int = 16, gain: float = GAIN, cell: int = CELL) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; shard sizes differ by one row at most."""
    text = F.coalesce("text", F.lit(""))
    nodes = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("hub")))
    total = nodes.count()
    # a hub goes by its least row here
    sizes = nodes.groupBy("hub").agg(F.count("*").alias("linked"), F.min("row").alias("least")).where("linked > 1")
    own, heavy = nodes.select("row", "hub"), sizes.where(F.col("linked") * HEAVY > total)
    light = own.join(F.broadcast(heavy.select("hub")), "hub", "left_anti").join(sizes, "hub")
    linked = stored(own.join(F.broadcast(heavy), "hub").union(light).select(
        "row", "linked", F.col("least").alias("hub")))
    quota = max(QUOTA * total, SLACK * linked.count()) / shards
    placed = stored(linked.select("row", "linked").join(propagate(linked, shards, quota, gain, cell), "row"))
    # rows without links go where shards have room: a drawn number falls into the part of one shard
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    rooms = [max(0.0, total / shards - held.get(k, 0)) for k in range(shards)]
    parts_of = list(accumulate(x / max(sum(rooms), 1e-9) for x in rooms))[:-1]
    filled = sum(((_drawn("row", F.lit(3)) >= x).cast("int") for x in parts_of), F.lit(0))
    laid = nodes.join(placed.select("row", "shard", "linked"), "row", "left").select(
        "row", "doc_id", "size", "text_crc32", "hub", F.coalesce("linked", F.lit(1)).alias("linked"),
        F.coalesce("shard", filled).alias("label"),
        F.when(F.col("shard").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("row", F.lit(9)), F.lit(2)) * 2)
        .cast("int").alias("zone"))
    # layout order: label, linked rows between two zones of others, cell; hubs above a cell's size have
    # cells of their own
    large = F.col("linked") > cell
    salt = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 20))
    parts = max(1, round(total / shards / cell))
    keyed = laid.select(
        "row", "doc_id", "size", "text_crc32", "hub", "label", "zone",
        F.when(large, F.col("hub")).otherwise(F.lit("")).alias("own"),
        F.when(large, F.pmod(salt, F.ceil(F.col("linked") / cell).cast("bigint")))
        .when(F.col("zone") != 1, F.pmod(salt, F.lit(parts)))
        .otherwise(F.pmod(F.xxhash64("hub"), F.lit(parts))).alias("part"))
    keyed = stored(keyed)
    cell_key = ["label", "zone", "own", "part"]
    cells = keyed.groupBy(*cell_key).agg(F.count("*").alias("n"))
    # one row per cell: rows / cell of them, not rows
    before = cells.withColumn("before", F.sum("n").over(
        Window.orderBy(*cell_key).rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    place = F.row_number().over(Window.partitionBy(*cell_key).orderBy("hub", "row")) - 1
    at = F.col("at")
    ordered = keyed.withColumn("inside", place).join(before, cell_key).select(
        "doc_id", "size", "text_crc32", (F.coalesce("before", F.lit(0)) + F.col("inside")).alias("at"))
    # the first `more` shards hold one row more than the others
    least, more = divmod(total, shards)
    edge = more * (least + 1)
    shard = F.when(at < edge, F.floor(at / (least + 1))).otherwise(
        more + F.floor((at - edge) / max(1, least)))
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "shard",
        (at - F.col("shard") * least - F.least(F.col("shard"), F.lit(more))).cast("bigint").alias("slot"))
