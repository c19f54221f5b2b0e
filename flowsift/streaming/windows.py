"""Windows of many sources at once: array operations, and the stateful operator that keeps what they need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsift.schema import EPSILON
from flowsift.streaming.packed import PACK_BYTES, pack, unpack, whole_rows

MICROS = 1_000_000
SOURCE, DESTINATION = "source", "destination"
NARROW = ["_t", "src_ip", "dst_ip", "dst_port"]
# rows leave the operator in tables of so many
TABLE_ROWS = 20_000
# entropy sums are whole multiples of this part, so that they don't drift
_PART = 1 << 36
# counts of a value above which those sums don't fit 64 bits
_WIDE = 1 << 22
_NEVER = np.iinfo(np.int64).max
_LOW = 62


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number from 0 on per distinct value, and the values; null is one."""
    found = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _pairs(first: np.ndarray, second: np.ndarray, seconds: int) -> np.ndarray:
    """A number per distinct pair; `second` is below `seconds`."""
    pair = first * seconds + second
    return np.unique(pair, return_inverse=True)[1] if len(pair) and (int(first.max()) + 1) * seconds > 1 << 31 else pair


def _along(times: np.ndarray, new: np.ndarray, width: int) -> np.ndarray:
    """A coordinate that never falls: two rows lie at most `width` apart in it if they do so in one group."""
    return np.cumsum(np.where(new, width + 1, np.minimum(np.diff(times, prepend=times[:1]), width + 1)))


def _before(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place, and of all."""
    return np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])


class _Values:
    """Occurrences of a value per group, among rows in time order along the coordinate `at`."""

    def __init__(self, group: np.ndarray, at: np.ndarray, width: int):
        n = len(group)
        self.order = np.argsort(group, kind="stable")
        group, self.at, self.width = group[self.order], at[self.order], width
        self.new = np.diff(group, prepend=-1) != 0
        # 1 where no occurrence precedes within the width, 1 where none follows
        self.appears, self.vanishes = np.empty(n, np.int64), np.empty(n, np.int64)
        self.appears[self.order] = self.new | (np.diff(self.at, prepend=self.at[:1]) > width)
        self.vanishes[self.order] = (np.diff(group, append=-1) != 0) | (np.diff(self.at, append=self.at[-1:]) > width)

    def distinct(self, start: np.ndarray) -> np.ndarray:
        return np.cumsum(self.appears) - _before(self.vanishes)[start]

    def logs(self, start: np.ndarray) -> np.ndarray:
        """Sum over the values of a window of c log c, c being a value's count, in whole parts."""
        along, place = _along(self.at, self.new, self.width), np.arange(len(self.at))
        entered = place - np.searchsorted(along, along - self.width, "left") + 1
        leaving = np.searchsorted(along, along + self.width, "right") - place
        count = np.arange(max(entered.max(initial=0), leaving.max(initial=0)) + 1, dtype=np.float64)
        table = np.rint(count * np.log2(np.maximum(count, 1)) * _PART)
        table = np.array([int(x) for x in table], object) if len(table) > _WIDE else table.astype(np.int64)
        enter, leave = np.empty(len(place), table.dtype), np.empty(len(place), table.dtype)
        enter[self.order] = table[entered] - table[entered - 1]
        leave[self.order] = table[leaving] - table[leaving - 1]
        return np.cumsum(enter) - _before(leave)[start]


def _spread(count: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Population deviation in seconds of gaps in microseconds; the sums, of Python's whole numbers, are exact."""
    wide = count.astype(object) * squares - total.astype(object) ** 2
    return np.sqrt(wide.astype(np.float64)) / np.maximum(count, 1) / MICROS


class _Lives:
    """Sums of gaps per source: last, gaps, total, squares, least, most; a place per source."""

    WHOLE = ("last", "gaps", "total", "least", "most")

    def __init__(self, kept: pa.Table | None, places: np.ndarray, sources: int):
        self.known = np.zeros(sources, bool)
        self.sums = {c: np.zeros(sources, np.int64) for c in self.WHOLE}
        self.sums["least"][:], self.sums["most"][:] = _NEVER, -1
        self.squares = np.zeros(sources, object)
        if kept is not None:
            self.known[places] = True
            for c in self.WHOLE:
                self.sums[c][places] = kept[c].to_numpy()
            high, low = (kept[c].to_numpy().astype(object) for c in ("high", "low"))
            self.squares[places] = high * (1 << _LOW) + low

    def table(self, names: pa.Array) -> pa.Table:
        at = np.flatnonzero(self.known)
        squares = self.squares[at]
        whole = {"high": squares >> _LOW, "low": squares & ((1 << _LOW) - 1)} | {c: self.sums[c][at] for c in self.WHOLE}
        return pa.table({"src_ip": names.take(pa.array(at)), **{c: pa.array(v.astype(np.int64)) for c, v in whole.items()}})

    def follow(self, source: np.ndarray, times: np.ndarray, forget: int | None) -> dict[str, np.ndarray]:
        """Intervals of flows, sorted by source and time; the sums move on behind them."""
        first = np.diff(source, prepend=-1) != 0
        gap = times - np.where(first, self.sums["last"][source], np.concatenate([times[:1], times[:-1]]))
        known = np.where(first, self.known[source], True)
        if forget is not None:
            known &= gap <= forget
        gap = np.where(known, gap, 0)
        starts = np.flatnonzero(first | ~known)
        life = np.cumsum(first | ~known) - 1
        # sums of a source hold where its first flow goes on from its last one
        held, of = known[starts], source[starts]

        def summed(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
            sums = _before(values)
            return sums[1:] - sums[starts][life] + np.where(held, kept[of], 0)[life]

        count, total = summed(known.astype(np.int64), self.sums["gaps"]), summed(gap, self.sums["total"])
        squares = summed(gap.astype(object) ** 2, self.squares)
        least = pd.Series(np.where(known, gap, _NEVER)).groupby(life).cummin().to_numpy()
        least = np.minimum(least, np.where(held, self.sums["least"][of], _NEVER)[life])
        most = pd.Series(np.where(known, gap, -1)).groupby(life).cummax().to_numpy()
        most = np.maximum(most, np.where(held, self.sums["most"][of], -1)[life])
        ends = np.flatnonzero(np.diff(source, append=-1) != 0)
        at = source[ends]
        self.known[at], self.squares[at] = True, squares[ends]
        for c, values in zip(self.WHOLE, (times, count, total, least, most)):
            self.sums[c][at] = values[ends]
        some = count > 0
        return {"iat_mean": np.where(some, total / np.maximum(count, 1) / MICROS, 0.0), "iat_std": np.where(some, _spread(count, total, squares), 0.0),
                "iat_min": np.where(some, least / MICROS, 0.0), "iat_max": np.where(some, most / MICROS, 0.0)}


def move_on(ready: pa.Table, recent: pa.Table | None, kept: pa.Table | None, passed: int, width: int, forget: int | None):
    """(ready flows with the features of their source, leaving steps, flows still in the window or none, sums of gaps).

    No other flow up to `passed` is missing, and recent flows lie before all ready ones.
    """
    ready = ready.take(pc.sort_indices(ready, [("_t", "ascending"), ("uid", "ascending")]))
    rows = ready.select(NARROW) if recent is None else pa.concat_tables([recent, ready.select(NARROW)])
    before, older = (0 if kept is None else len(kept)), len(rows) - len(ready)
    source, names = _codes(pa.chunked_array([*([] if kept is None else kept["src_ip"].chunks), *rows["src_ip"].chunks], rows.schema.field("src_ip").type))
    lives = _Lives(kept, source[:before], len(names))
    source = source[before:]
    order = np.argsort(source, kind="stable")
    rows, source = rows.take(pa.array(order)).combine_chunks(), source[order]
    times, at_ready = rows["_t"].to_numpy(), order >= older
    (ips, ip_names), (ports, port_names) = _codes(rows["dst_ip"]), _codes(rows["dst_port"])
    along = _along(times, np.diff(source, prepend=-1) != 0, width)
    start = np.searchsorted(along, along - width, "left")
    by_ip = _Values(_pairs(source, ips, len(ip_names)), along, width)
    by_port = _Values(_pairs(source, ports, len(port_names)), along, width)
    by_pair = _Values(_pairs(_pairs(source, ips, len(ip_names)), ports, len(port_names)), along, width)
    flows = np.arange(len(times)) - start + 1
    gap = np.where(np.diff(source, prepend=-1) != 0, 0, np.diff(times, prepend=times[:1])).astype(object)
    squares = np.cumsum(gap ** 2)
    entropy = np.maximum(np.log2(flows) - by_ip.logs(start).astype(np.float64) / _PART / flows, 0.0)
    at = np.flatnonzero(at_ready)
    frequency = flows[at]
    spread = _spread(frequency - 1, times[at] - times[start[at]], squares[at] - squares[start[at]])
    values = {
        "fan_out": by_pair.distinct(start)[at].astype(np.float64), "unique_dst_ips": by_ip.distinct(start)[at],
        "unique_dst_ports": by_port.distinct(start)[at], **lives.follow(source[at], times[at], forget),
        "connection_frequency": frequency.astype(np.float64), "src_ip_entropy": entropy[at],
        "periodicity_score": np.where(frequency > 1, 1.0 / np.maximum(spread, EPSILON), 0.0), "_step": by_ip.appears[at],
    }
    done = ready.take(pa.array(order[at] - older))
    for name, value in values.items():
        done = done.append_column(name, pa.array(value))
    # what later flows, all of them behind `passed`, can't reach any more
    gone = times < passed - width
    left = rows.filter(pa.array(gone & (by_ip.vanishes == 1)))
    steps = pa.table({"dst_ip": left["dst_ip"], "_t": pc.add(left["_t"], width), "_step": pa.array(np.full(len(left), -1, np.int64))})
    still = rows.filter(pa.array(~gone))
    return done, steps, still if len(still) else None, lives.table(names)


class KeyedWindows(StatefulProcessor):
    """State of one bucket of sources. Rows come as packed tables, and with a schema they leave as its columns.

    Out of it come flows with the features of their source and with `_step`, 1 where their source is new at their
    destination, and rows of a destination with a step of -1 at the time a source has left it.
    """

    def __init__(self, window_seconds: float, forget_seconds: float | None, schema: pa.Schema | None = None):
        self.schema = schema
        self.width = round(window_seconds * MICROS)
        self.forget = None if forget_seconds is None else round(forget_seconds * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "passed bigint, recent binary, sums binary")

    def _wake(self, micros: int) -> None:
        """As soon as the watermark has reached that time."""
        self.handle.registerTimer(-(-micros // 1000))

    def _out(self, rows: pa.Table | list, side: str, late: bool) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        for name, value in (("side", side), ("late", late)):
            rows = rows.append_column(name, pa.repeat(value, len(rows)))
        for low in range(0, len(rows), TABLE_ROWS):
            part = rows.slice(low, TABLE_ROWS).combine_chunks()
            if self.schema is None:
                yield pd.DataFrame({"rows": [pack(part)]})
            else:
                whole = whole_rows(part.to_batches()[0], self.schema)
                # columns of Arrow's own kind: a whole number beside a null stays one
                yield pd.DataFrame({f.name: pd.arrays.ArrowExtensionArray(whole.column(f.name)) for f in self.schema})

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh, size, first, late, behind = [], 0, _NEVER, [], 0
        for frame in rows:
            for packed in frame["rows"]:
                flows = unpack(packed)
                is_late = pc.fill_null(pc.less_equal(flows["_t"], passed), True)
                if pc.any(is_late).as_py():
                    late.append(flows.filter(is_late))
                    behind += len(late[-1])
                    flows = flows.filter(pc.invert(is_late))
                    packed = pack(flows)
                if len(flows):
                    fresh.append((packed,))
                    size, first = size + len(packed), min(first, pc.min(flows["_t"]).as_py())
                if size >= PACK_BYTES:
                    self.waiting.appendList(fresh)
                    fresh, size = [], 0
                if behind >= TABLE_ROWS:
                    yield from self._out(pa.concat_tables(late), SOURCE, True)
                    late, behind = [], 0
        if fresh:
            self.waiting.appendList(fresh)
        if first < _NEVER:
            self._wake(first)
        if late:
            yield from self._out(pa.concat_tables(late), SOURCE, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done, recent, sums = self.kept.get() or (None, None, None)
        if done == passed:
            return  # another timer of the same batch
        recent, sums = (None if x is None else unpack(bytes(x)) for x in (recent, sums))
        held = [unpack(bytes(packed)) for (packed,) in self.waiting.get()] if self.waiting.exists() else []
        ready, due = None, []
        if held:
            rows = pa.concat_tables(held)
            is_ready = pc.less_equal(rows["_t"], passed)
            ready, rest = rows.filter(is_ready), rows.filter(pc.invert(is_ready))
            if not len(rest):
                self.waiting.clear()
            else:
                due.append(pc.min(rest["_t"]).as_py())
                if len(ready):
                    self.waiting.put([(pack(rest),)])
        elif recent is not None:
            ready = recent.slice(0, 0).append_column("uid", pa.nulls(0, pa.string()))
        found, steps = [], []
        if ready is not None:
            found, steps, recent, sums = move_on(ready, recent, sums, passed, self.width, self.forget)
        if sums is not None and self.forget is not None:
            sums = sums.filter(pc.greater(sums["last"], passed - self.forget))
            due += [pc.min(sums["last"]).as_py() + self.forget] if len(sums) else []
        if recent is not None:
            due.append(pc.min(recent["_t"]).as_py() + self.width + 1)
        self.kept.update((passed, *(pack(x) if x is not None and len(x) else None for x in (recent, sums))))
        if due:
            self._wake(min(due))
        yield from self._out(found, SOURCE, False)
        yield from self._out(steps, DESTINATION, False)

    def close(self) -> None:
        # the worker stays for later tasks
        pa.default_memory_pool().release_unused()
