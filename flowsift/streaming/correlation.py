"""Kill chains over the alert stream: cycles in event time, each over a look-back of its source's alerts.

A source keeps the alerts of the look-back in keyed state. A timer wakes it at its next cycle that sees an alert,
and it goes through all cycles that the watermark has passed at once; what the cycle sees and assigns is what `operators.alerts.correlate` would over the whole table at
that moment. Nothing older is read again, and a source without alerts costs nothing. Files are not
rewritten: each batch appends the new chain ids, and readers join them in.

A row without an id is no alert but a heartbeat that moves the watermark on. An alert behind the watermark has
missed its cycle and is seen by the next ones that reach back to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsift.operators.alerts import LOOKBACK, correlate, write_back
from flowsift.streaming.features import with_keyed_state
from flowsift.streaming.store import batch_numbers, read_table, write_batch

# fixed value: the service correlates this often
CYCLE = timedelta(seconds=30)
_ALERT = "t bigint, id string, threat_class string, kill_chain_id string"
_FIELDS = ["t", "id", "threat_class", "kill_chain_id"]
_CHAINED = Row("id", "src_ip", "kill_chain_id")
_MICROS = timedelta(microseconds=1)


def tagged_alerts(spark: SparkSession, alerts_table: str, chains_table: str) -> DataFrame:
    """Alerts with the chain ids of all cycles so far."""
    alerts = read_table(spark, alerts_table)
    if not batch_numbers(spark, chains_table):
        return alerts
    given = read_table(spark, chains_table).groupBy("id").agg(
        F.min_by("kill_chain_id", "batch").alias("kill_chain_id")
    )
    return write_back(alerts, given)


def correlation_cycle(spark: SparkSession, alerts_table: str, chains_table: str, now: datetime, cycle: int) -> None:
    """One cycle over a whole table, by hand; running a cycle again replaces its own output."""
    write_batch(correlate(tagged_alerts(spark, alerts_table, chains_table), now), chains_table, cycle)


def new_chain(source: str, first_id: str) -> str:
    return "kc-" + hashlib.md5(f"{source}|{first_id}".encode()).hexdigest()


class KeyedChains(StatefulProcessor):
    """State of one source: its alerts that a coming cycle can still see."""

    def __init__(self, lookback: timedelta, cycle: timedelta, min_classes: int):
        self.lookback, self.cycle, self.min_classes = lookback // _MICROS, cycle // _MICROS, min_classes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", _ALERT)
        self.coming = handle.getValueState("coming", "moment bigint")

    def _cycle_of(self, t: int) -> int:
        """The first cycle at or after a time."""
        return -(-t // self.cycle) * self.cycle

    def _wake(self, moment: int) -> None:
        self.coming.update((moment,))
        self.handle.registerTimer(-(-moment // 1000))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [tuple(row)[-len(_FIELDS):] for row in rows]
        self.alerts.appendList(fresh)
        first = self._cycle_of(max(min(r[0] for r in fresh), passed + 1))
        coming = self.coming.get()
        if coming is None or first < coming[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        coming = self.coming.get()
        # a timer that an earlier one has overtaken finds nothing to do
        if coming is None or coming[0] > passed:
            return iter(())
        # timers have whole milliseconds, and so do cycles
        now, held, out = coming[0], sorted(self.alerts.get()), []
        while held and now <= passed:
            given = self._given(key[0], [r for r in held if now - self.lookback <= r[0] <= now])
            out += [_CHAINED(i, key[0], chain) for i, chain in given.items()]
            # what the next cycle reaches back to
            held = [(*r[:3], r[3] or (given.get(r[1]) if r[0] <= now else None)) for r in held
                    if r[0] >= now + self.cycle - self.lookback]
            if held:
                now = max(now + self.cycle, self._cycle_of(held[0][0]))
        if held:
            self.alerts.put(held)
            self._wake(now)
        else:
            self.alerts.clear()
            self.coming.clear()
        return iter(out)

    def _given(self, source: str, seen: list) -> dict:
        """Chain ids of one cycle; seen: its alerts in order of time and id."""
        if len({r[2] for r in seen}) < self.min_classes:
            return {}
        tagged = [r for r in seen if r[3]]
        chain = tagged[0][3] if tagged else new_chain(source, seen[0][1])
        return {r[1]: chain for r in seen if not r[3]}

    def close(self) -> None:
        pass


def keyed_chains(alerts: DataFrame, lookback: timedelta = LOOKBACK, cycle: timedelta = CYCLE,
                 lateness: str = "10 seconds", min_classes: int = 2) -> DataFrame:
    """(id, src_ip, kill_chain_id) of a stream's alerts, as cycles assign them.

    alerts: id, src_ip, threat_class, kill_chain_id, ingested_at. `cycle` is a whole number of milliseconds.
    """
    if cycle % timedelta(milliseconds=1):
        raise ValueError("a cycle lasts whole milliseconds")
    kept = F.struct("src_ip", F.unix_micros("ingested_at").alias("t"), "id", "threat_class", "kill_chain_id")
    counts = F.col("id").isNotNull() & (F.col("threat_class") != "benign") & (F.coalesce("src_ip", F.lit("")) != "")
    # dropped where the watermark has seen them
    rows = alerts.withWatermark("ingested_at", lateness).select(
        F.explode(F.when(counts & F.col("ingested_at").isNotNull(), F.array(kept))).alias("_a")).select("_a.*")
    return rows.groupBy("src_ip").transformWithState(
        KeyedChains(lookback, cycle, min_classes), "id string, src_ip string, kill_chain_id string", "Append", "eventTime")


def start_correlation(alerts: DataFrame, chains_table: str, checkpoint: str, lookback: timedelta = LOOKBACK,
                      cycle: timedelta = CYCLE, lateness: str = "10 seconds", once: bool = False,
                      interval: str = "2 seconds"):
    """Starts the query that appends chain ids; state lies in `checkpoint`, a folder that all machines share."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, chains_table, batch_id)

    return with_keyed_state(keyed_chains(alerts, lookback, cycle, lateness), write, checkpoint, once, interval)
