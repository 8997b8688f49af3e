"""Rules with keyed state and event-time timers.

State lives in the RocksDB store, keyed by address or user. Times are kept as sorted
arrays of distinct milliseconds with their counts, in runs of bounded length, so a
call of Python handles a whole batch of a key with array operations and never holds
more than a few runs. Calls of the store are what such a stream spends its time on: a
key with one run is one value, and has one timer out. When it fires, all that the
watermark has passed is closed, and its state goes.

Rows are merged per key and millisecond inside each Arrow batch before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spoorlog.functions import predicates as is_
from spoorlog.functions.text import non_empty
from spoorlog.operators.sliding import PIECE_MS

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
ADDRESS = ["session_id", "ip"]
#: Event time goes to Python, whose frames end in 2262; later times count as this one for the watermark.
LAST = "2250-01-01 00:00:00"
#: Instants in a run of state.
RUN = 8192
WINDOWS = "session_id string, ip string, kind string, bucket bigint, value bigint, anchor bigint"


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed state needs, while a stream starts; the caller's own choice of a store stands."""
    mine = {k: v for k, v in STORE.items() if spark.conf.get(k, None) in (None, "") or "HDFSBacked" in spark.conf.get(k)}
    before = {k: spark.conf.get(k, None) for k in mine}
    try:
        for k, v in mine.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def merged(df: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows folded per batch before they are shuffled, so a hot key arrives as few rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = fold(batch)
                yield out.astype({c: object for c in out.columns if out[c].dtype.kind not in "iu"})

    return df.mapInPandas(run, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows of a processor; plain objects, as frames of several calls are joined behind it."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


# ---- sliding windows --------------------------------------------------------


def _prefix(ms: np.ndarray, total: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of the counts at instants up to each of x; ``total`` is their running sum with a leading 0."""
    return total[np.searchsorted(ms, x, "right")]


class SlidingAlerts(StatefulProcessor):
    """Exact anchored windows per address, and an alert on the row that exceeds.

    ``alert`` rows come out with the batch that brings the exceeding row: value is
    the count of the trailing window at that row, anchor its instant; an address is
    quiet for one window's length after an alert. ``window`` rows come out when the
    watermark closes a bucket: its greatest anchored window, if in excess.

    An address with few instants, as most are, is one value of state with one timer
    out, so a batch costs it a read and a write however its rows are spread. One with
    more has them in runs of at most ``RUN`` instants, of which a call reads those it needs.
    """

    def __init__(self, width: int, threshold: int) -> None:
        self.width, self.threshold = width, threshold
        self.piece = min(width, PIECE_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # First instant and number of rows of each run, greatest window of each open bucket; the instants too if they are one run.
        self.head = handle.getValueState(
            "head", "first binary, total binary, best binary, alerted bigint, due bigint, ms binary, n binary")
        self.runs = handle.getMapState("runs", "first bigint", "ms binary, n binary")

    def _load(self) -> bool:
        got = self.head.get()
        if got is None:
            got = (b"", b"", b"", None, None, b"", b"")
        first, total, best, self.alerted, self.due, ms, n = got
        self.first, self.total = np.frombuffer(first, np.int64), np.frombuffer(total, np.int64)
        rows = np.frombuffer(best, np.int64).reshape(-1, 3).tolist()
        self.best = {bucket: (value, anchor) for bucket, value, anchor in rows}
        self.inline = (np.frombuffer(ms, np.int64), np.frombuffer(n, np.int64)) if ms else None
        return bool(len(self.first))

    def _save(self) -> None:
        best = np.array([(b, *v) for b, v in self.best.items()], np.int64)
        ms, n = self.inline or (np.zeros(0, np.int64),) * 2
        self.head.update((
            self.first.tobytes(), self.total.tobytes(), best.tobytes(), self.alerted, self.due, ms.tobytes(), n.tobytes()))

    def _read(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        if self.inline:
            return self.inline
        ms, n = self.runs.getValue((int(self.first[run]),))
        return np.frombuffer(ms, np.int64), np.frombuffer(n, np.int64)

    def _replace(self, run: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Put parts, ascending, in the place of a run."""
        if len(self.first) > 1:
            self.runs.removeKey((int(self.first[run]),))
        self.first = np.concatenate([self.first[:run], [ms[0] for ms, _ in parts], self.first[run + 1 :]]).astype(np.int64)
        self.total = np.concatenate([self.total[:run], [n.sum() for _, n in parts], self.total[run + 1 :]]).astype(np.int64)
        self.inline = None
        if len(self.first) == 1:
            self.inline = parts[0] if parts else self._read(0)
            if not parts:
                self.runs.removeKey((int(self.first[0]),))
        else:
            for ms, n in parts:
                self.runs.updateValue((int(ms[0]),), (ms.tobytes(), n.tobytes()))

    def _add(self, fresh: np.ndarray, counts: np.ndarray) -> None:
        where = np.maximum(np.searchsorted(self.first, fresh, "right") - 1, 0)
        for run in np.unique(where)[::-1].tolist():  # from the last, as a run that is split moves those behind it
            at = where == run
            old_ms, old_n = self._read(run) if len(self.first) else (fresh[:0], counts[:0])
            ms, inverse = np.unique(np.concatenate([old_ms, fresh[at]]), return_inverse=True)
            n = np.zeros(len(ms), np.int64)
            np.add.at(n, inverse, np.concatenate([old_n, counts[at]]))
            size = len(ms) if len(ms) <= RUN else RUN // 2
            self._replace(run, [(ms[i : i + size], n[i : i + size]) for i in range(0, len(ms), size)])

    def _up_to(self, x: np.ndarray) -> np.ndarray:
        """How many rows held lie at or before each instant; reads only the runs that hold one of them."""
        own = np.searchsorted(self.first, x, "right") - 1
        out = np.concatenate(([0], np.cumsum(self.total)))[np.maximum(own, 0)]
        for run in np.unique(own[own >= 0]).tolist():
            ms, n = self._read(run)
            at = own == run
            out[at] += _prefix(ms, np.concatenate(([0], np.cumsum(n))), x[at])
        return out

    def _timer(self) -> None:
        """A timer for when nothing that windows anchored in the first piece reach can still come."""
        first = int(self.first[0])
        due = first - first % self.piece + self.piece + self.width
        if self.due is None or due < self.due:
            self.due = due
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = [(b["ms"].to_numpy(np.int64), b["n"].to_numpy(np.int64)) for b in rows]
        ms, n = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        fresh, where = np.unique(ms, return_inverse=True)
        counts = np.zeros(len(fresh), np.int64)
        np.add.at(counts, where, n)
        self._load()
        self._add(fresh, counts)
        self._timer()
        # Rows in [t - width, t] at each new instant t.
        trailing = self._up_to(fresh) - self._up_to(fresh - self.width - 1)
        over = np.flatnonzero(trailing > self.threshold)
        out = []
        while len(over):
            first = over[0]
            if self.alerted is None or fresh[first] > self.alerted + self.width:
                self.alerted = int(fresh[first])
                out.append((*key, "alert", self.alerted - self.alerted % self.width, int(trailing[first]), self.alerted))
            over = over[np.searchsorted(fresh[over], self.alerted + self.width, "right") :]
        self._save()
        if out:
            yield _frame(out, [*ADDRESS, "kind", "bucket", "value", "anchor"])

    def _close(self, ms: np.ndarray) -> None:
        """Windows anchored at these instants are whole; the greatest of each bucket is kept."""
        counts = self._up_to(ms + self.width) - self._up_to(ms - 1)
        bucket = ms - np.mod(ms, self.width)
        for at in np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist():
            inside = slice(at, np.searchsorted(bucket, bucket[at], "right"))
            top = at + int(np.argmax(counts[inside]))
            if counts[top] > self.best.get(int(bucket[at]), (self.threshold, 0))[0]:
                self.best[int(bucket[at])] = (int(counts[top]), int(ms[top]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._load():
            return
        reach = timerValues.getCurrentWatermarkInMs() - self.width
        while len(self.first) and self.first[0] < reach:
            ms, n = self._read(0)
            closed = int(np.searchsorted(ms, reach, "left"))
            self._close(ms[:closed])
            self._replace(0, [(ms[closed:], n[closed:])] if closed < len(ms) else [])
            if closed < len(ms):
                break
        # A bucket is done when nothing held lies in it.
        done = [b for b in sorted(self.best) if not len(self.first) or b + self.width <= self.first[0]]
        out = [(*key, "window", b, *self.best.pop(b)) for b in done]
        if len(self.first):
            self.due = None
            self._timer()
            self._save()
        else:
            self.head.clear()  # the row of the last alert is behind too, so nothing is quiet any more
        if out:
            yield _frame(out, [*ADDRESS, "kind", "bucket", "value", "anchor"])


def _marked(df: DataFrame, lateness: str) -> DataFrame:
    """Rows with ``ms`` under a watermark."""
    time = F.least(F.timestamp_millis("ms"), F.lit(LAST).cast("timestamp"))
    return df.withColumn("ts", time).withWatermark("ts", lateness)


def _per_instant(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.groupby([*ADDRESS, "ms"], sort=False, dropna=False).size().reset_index(name="n")


def stream_windows(entries: DataFrame, when: Column, threshold: int, width_ms: int = 300_000, lateness: str = "10 minutes") -> DataFrame:
    """session_id, ip, kind, bucket, value, anchor of :class:`SlidingAlerts` over the matching entries.

    The greatest ``window`` row of an address is the batch rule's result. Entries
    without time, at the epoch or without address match nothing.
    """
    ms = F.unix_millis("ts")
    timed = entries.filter(when & (ms != 0) & F.col("ip").isNotNull()).select(*ADDRESS, ms.alias("ms"))
    counted = merged(timed, _per_instant, "session_id string, ip string, ms bigint, n bigint")
    return _marked(counted, lateness).groupBy(*ADDRESS).transformWithStateInPandas(
        statefulProcessor=SlidingAlerts(width_ms, threshold), outputStructType=WINDOWS, outputMode="Append", timeMode="EventTime")


# ---- first seen -------------------------------------------------------------

FIRST_SEEN = ["session_id", "user", "pattern"]
FIRST_ROW = "session_id string, user string, pattern string, ms bigint, line_num bigint, raw_line string"


class FirstSeen(StatefulProcessor):
    """The first entry of each pattern of a user by time and line, once nothing earlier can come.

    The least entry is held until the watermark passes its time. A mark then says
    that the pattern has been seen; it falls when it has been quiet for ``quiet`` ms
    of event time, and a later entry is a first one again. A user's patterns, a few
    at most, are one value of state with one timer out.
    """

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Per pattern the least entry, with no line number once it has come out, and the latest time.
        self.held = handle.getValueState(
            "held", "pattern array<string>, ms array<bigint>, line_num array<bigint>, raw_line array<string>, latest array<bigint>, due bigint")

    def _load(self) -> tuple[dict[str, list], int | None]:
        got = self.held.get()
        if got is None:
            return {}, None
        return {p: entry for p, *entry in map(list, zip(*got[:5], strict=True))}, got[5]

    def _save(self, held: dict[str, list], due: int | None) -> None:
        """Writes the state, and sees to a timer for whatever comes next."""
        if not held:
            self.held.clear()
            return
        nearest = min(latest + self.quiet if line_num is None else ms + 1 for ms, line_num, _, latest in held.values())
        if due is None or nearest < due:
            due = nearest
            self.handle.registerTimer(due)
        self.held.update((list(held), *map(list, zip(*held.values(), strict=True)), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, list] = {}
        for batch in rows:
            for pattern, *entry in zip(*[batch[c].tolist() for c in ("pattern", "ms", "line_num", "raw_line", "last")], strict=True):
                known = fresh.setdefault(pattern, entry)
                known[3] = max(known[3], entry[3])
                if entry[:2] < known[:2]:
                    known[:3] = entry[:3]
        held, due = self._load()
        for pattern, entry in fresh.items():
            known = held.get(pattern)
            if known is None or known[1] is None and entry[0] > known[3] + self.quiet:  # quiet for long enough, though its timer has not run yet
                held[pattern] = entry
                continue
            known[3] = max(known[3], entry[3])
            if known[1] is not None and entry[:2] < known[:2]:
                known[:3] = entry[:3]
        self._save(held, due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        held, _ = self._load()
        for pattern, entry in held.items():
            if entry[1] is not None and entry[0] < now:
                out.append((*key, pattern, *entry[:3]))
                entry[1:3] = None, None
        held = {p: entry for p, entry in held.items() if entry[1] is not None or entry[3] + self.quiet > now}
        self._save(held, None)
        if out:
            yield _frame(out, [*FIRST_SEEN, "ms", "line_num", "raw_line"])


def _first_of_batch(batch: pd.DataFrame) -> pd.DataFrame:
    """The least entry of each key, and the latest time."""
    ordered = batch.sort_values(["ms", "line_num"], kind="stable")
    first = ordered.drop_duplicates(FIRST_SEEN).copy()
    last = batch.groupby(FIRST_SEEN, sort=False, dropna=False)["ms"].max().rename("last").reset_index()
    return first.merge(last, on=FIRST_SEEN)[[*FIRST_SEEN, "ms", "line_num", "raw_line", "last"]]


def stream_first_seen_closed(
    entries: DataFrame, words: list[str] | None = None, quiet_ms: int = 30 * 24 * 3_600_000, lateness: str = "10 minutes"
) -> DataFrame:
    """session_id, user, pattern, ms, line_num, raw_line: each user's first entry with a privilege pattern, as one final row.

    Entries without time are left out, as they have no place before or after others.
    """
    user = F.coalesce(non_empty(F.col("user_name")), F.lit("unknown"))
    line = F.coalesce(F.col("line_num").cast("bigint"), F.lit(0)).alias("line_num")
    matched = entries.select(
        "session_id", user.alias("user"), is_.privilege_pattern(F.col("raw_line"), words).alias("pattern"),
        F.unix_millis("ts").alias("ms"), line, "raw_line").filter(F.col("pattern").isNotNull() & F.col("ms").isNotNull())
    least = merged(matched, _first_of_batch, FIRST_ROW + ", last bigint")
    return _marked(least, lateness).groupBy(*FIRST_SEEN[:2]).transformWithStateInPandas(
        statefulProcessor=FirstSeen(quiet_ms), outputStructType=FIRST_ROW, outputMode="Append", timeMode="EventTime")
