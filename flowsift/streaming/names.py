"""Name queries of the window before each flow, over two streams: an interval join that never forms pairs.

Flows and queries each have a watermark; the slower one rules. Both go to their source as one keyed table: a
flow waits until the watermark has passed it, when every query that counts for it is there, and queries stay for
one window. A source's flows leave in time order over a sweep of its queries, so the cost is that of both
tables, not of their matches. All sums are whole numbers, as in batch.

Flows and queries behind the watermark leave at once, marked as late. A row without a uid, or a query without a
name, is no row but a heartbeat that moves its stream's watermark on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsift.functions.scalar import event_time, ticks
from flowsift.operators.dns import MEASURES, measured, features_of_measures
from flowsift.operators.rolling import MICROS
from flowsift.schema import WINDOW_SECONDS
from flowsift.streaming.features import with_keyed_state
from flowsift.streaming.store import read_batch, write_batch

SUMMED = [c for c, kind in MEASURES.items() if kind == "sum"]
(LARGEST,) = [c for c, kind in MEASURES.items() if kind == "max"]
_TYPES = {c: "double" if c == "_entropy" else "bigint" for c in MEASURES}
_ROW = "flow boolean, _t bigint, uid string, " + ", ".join(f"{c} {_TYPES[c]}" for c in MEASURES)
_NAMES = ["flow", "_t", "uid", *MEASURES]
_OUT = f"{_ROW}, late boolean"
_FOUND = Row(*_NAMES, "late")
# sums of entropies are whole multiples of this part
_PART = 1 << 36


class _Queries:
    """Queries of one window; sums move with its ends, the largest length waits in a falling row."""

    def __init__(self, width: int):
        self.width = width
        self.rows: deque = deque()
        self.falling: deque = deque()
        self.sums = [0] * len(SUMMED)

    @staticmethod
    def _whole(row) -> list[int]:
        return [round(row[_NAMES.index(c)] * _PART) if c == "_entropy" else int(row[_NAMES.index(c)]) for c in SUMMED]

    def enter(self, row) -> None:
        self.rows.append(row)
        self.sums = [a + b for a, b in zip(self.sums, self._whole(row))]
        size = row[_NAMES.index(LARGEST)]
        while self.falling and self.falling[-1][1] <= size:
            self.falling.pop()
        self.falling.append((row[1], size))

    def up_to(self, t: int) -> None:
        while self.rows and self.rows[0][1] < t - self.width:
            self.sums = [a - b for a, b in zip(self.sums, self._whole(self.rows.popleft()))]
        while self.falling and self.falling[0][0] < t - self.width:
            self.falling.popleft()

    def values(self) -> dict:
        found = dict(zip(SUMMED, self.sums)) | {LARGEST: int(self.falling[0][1])}
        return found | {"_entropy": found["_entropy"] / _PART}


class KeyedQueries(StatefulProcessor):
    """State of one source: flows and queries that wait, and the queries of the last window."""

    def __init__(self, window_seconds: float):
        self.width = round(window_seconds * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.recent = handle.getListState("recent", _ROW)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        late, fresh = [], []
        for row in rows:
            row = tuple(row)[-len(_NAMES):]
            (late if row[1] is None or row[1] <= passed else fresh).append(row)
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(r[1] for r in fresh))
        return iter([_FOUND(*row, True) for row in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        # a query at the time of a flow counts for it
        ready = sorted((r for r in held if r[1] <= passed), key=lambda r: (r[1], r[0], r[2] or ""))
        rest = [r for r in held if r[1] > passed]
        if ready and rest:
            self.waiting.put(rest)
            self._wake(min(r[1] for r in rest))
        elif ready:
            self.waiting.clear()
        window = _Queries(self.width)
        for row in self.recent.get() if self.recent.exists() else ():
            window.enter(row)
        found = []
        for row in ready:
            window.up_to(row[1])
            if not row[0]:
                window.enter(row)
            elif window.rows:
                values = window.values()
                found.append((True, row[1], row[2], *(values[c] for c in MEASURES)))
        window.up_to(passed)
        if window.rows:
            self.recent.put(list(window.rows))
            self._wake(window.rows[-1][1] + self.width + 1000)
        elif self.recent.exists():
            self.recent.clear()
        return iter([_FOUND(*row, False) for row in found])

    def close(self) -> None:
        pass


def keyed_queries(flows: DataFrame, events: DataFrame, window_seconds: float = WINDOW_SECONDS,
                  flow_lateness: float = 120.0, query_lateness: float = 120.0) -> DataFrame:
    """flows: uid, ts, src_ip; events: as dns_events gives them. One row of folded measures per flow with
    queries, and late rows of both streams."""
    def timed(rows: DataFrame, seconds: float) -> DataFrame:
        return rows.withColumn("_event_time", event_time("ts")).withWatermark(
            "_event_time", f"{round(seconds * 1000)} milliseconds")

    def behind(rows: DataFrame, is_row, *columns: str) -> DataFrame:
        """Rows without heartbeats, dropped where the watermark has seen them."""
        return rows.select(F.explode(F.when(is_row, F.array(F.struct(*columns)))).alias("_r")).select("_r.*")

    asked = measured(behind(timed(events, query_lateness), F.col("query") != "", "uid", "src_ip", "ts", "query", "qtype"))
    made = behind(timed(flows, flow_lateness), F.col("uid").isNotNull(), "uid", "src_ip", "ts").withColumn("_t", ticks("ts"))
    blank = [F.lit(None).cast(_TYPES[c]).alias(c) for c in MEASURES]
    both = asked.select(F.lit(False).alias("flow"), "_t", "uid", *MEASURES, "src_ip").union(
        made.select(F.lit(True), "_t", "uid", *blank, "src_ip"))
    return both.select("src_ip", *_NAMES).groupBy("src_ip").transformWithState(
        KeyedQueries(window_seconds), _OUT, "Append", "eventTime")


def split_queries(root: str):
    """foreachBatch writer under `root`: dns (the features of flows with queries) and late (flow, uid, _t)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{root}/found", batch_id)
        found = read_batch(batch.sparkSession, f"{root}/found", batch_id)
        write_batch(features_of_measures(found.filter("not late")), f"{root}/dns", batch_id)
        write_batch(found.filter("late").select("flow", "uid", "_t"), f"{root}/late", batch_id)

    return write


def start_queries(flows: DataFrame, events: DataFrame, root: str, window_seconds: float = WINDOW_SECONDS,
                  flow_lateness: float = 120.0, query_lateness: float = 120.0, once: bool = False,
                  interval: str = "2 seconds"):
    """Starts the query; its state lives beside its tables under `root`, a folder that all machines share."""
    rows = keyed_queries(flows, events, window_seconds, flow_lateness, query_lateness)
    return with_keyed_state(rows, split_queries(root), f"{root}/state", once, interval)
