"""Processors of keyed streams on a store of plain dicts, which counts the calls."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from spoorlog.streaming import keyed

T0 = 1_700_000_000_000


class Store:
    """State and timers of one key."""

    def __init__(self):
        self.calls, self.values, self.maps, self.timers = 0, {}, {}, set()

    def getValueState(self, name, schema):
        def did(out=None):
            self.calls += 1
            return out

        return SimpleNamespace(
            exists=lambda: did(name in self.values), get=lambda: did(self.values.get(name)),
            update=lambda v: did(self.values.update({name: v})), clear=lambda: did(self.values.pop(name, None)))

    def getMapState(self, name, key, schema):
        held = self.maps.setdefault(name, {})

        def did(out=None):
            self.calls += 1
            return out

        return SimpleNamespace(
            exists=lambda: did(bool(held)), containsKey=lambda k: did(k in held), getValue=lambda k: did(held[k]),
            updateValue=lambda k, v: did(held.update({k: v})), removeKey=lambda k: did(held.pop(k, None)), keys=lambda: did(list(held)))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def started(processor):
    store = Store()
    processor.init(store)
    return processor, store


def pushed(processor, key, frame):
    return [tuple(r) for f in processor.handleInputRows(key, iter([frame]), None) for r in f.itertuples(index=False)]


def passed(processor, store, key, watermark):
    """The rows of all timers up to a watermark."""
    out, values = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    for at in sorted(t for t in store.timers if t < watermark):
        info = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)
        out += [tuple(r) for f in processor.handleExpiredTimer(key, values, info) for r in f.itertuples(index=False)]
        store.timers.discard(at)
    return out


def instants(ms):
    return pd.DataFrame({"ms": ms, "n": np.ones(len(ms), np.int64)})


def test_spread_instants_cost_a_read_and_a_write():
    """rows in as many pieces of ten minutes as there are rows, once eight calls of the store a row and more a timer."""
    processor, store = started(keyed.SlidingAlerts(86_400_000, 2))
    pushed(processor, ("s", "a"), instants(T0 + 3_600_000 * np.arange(300)))
    assert store.calls <= 4 and len(store.timers) == 1
    rows = passed(processor, store, ("s", "a"), T0 + 10**11)
    assert store.calls <= 8 and len(rows) == 14 and not store.values and not store.timers


@pytest.mark.parametrize("size", [8, 8192])
def test_windows_in_runs_and_whole(monkeypatch, size):
    """Batches out of order, closed as the watermark moves; a crowded address is kept in runs."""
    monkeypatch.setattr(keyed, "RUN", size, raising=False)
    rng = np.random.default_rng(12)
    width, key = 50_000, ("s", "a")
    processor, store = started(keyed.SlidingAlerts(width, 3))
    ms = T0 + np.sort(rng.integers(0, 2_000_000, 400)) + rng.integers(0, 20_000, 400)
    windows, alerts, watermark = [], [], 0
    for lo in range(0, 400, 40):
        got = pushed(processor, key, instants(ms[lo : lo + 40]))
        for row in got:
            seen = ms[: lo + 40]
            assert row[4] == ((seen >= row[5] - width) & (seen <= row[5])).sum() > 3
        alerts += got
        watermark = int(ms[: lo + 40].max()) - 25_000
        windows += passed(processor, store, key, watermark)
    windows += passed(processor, store, key, T0 + 10**9)
    wanted = {}
    for t in sorted(set(ms.tolist())):
        n = int(((ms >= t) & (ms <= t + width)).sum())
        if n > wanted.get(t - t % width, (3, 0))[0]:
            wanted[t - t % width] = (n, t)
    assert {r[3]: r[4:] for r in windows} == wanted and len(windows) == len(wanted)
    assert alerts and not store.values and not store.maps.get("runs") and not store.timers


def entries(rows):
    return pd.DataFrame(rows, columns=["pattern", "ms", "line_num", "raw_line", "last"])


def test_patterns_of_a_user_share_state():
    """four patterns, once four keys of five calls each and two timers."""
    processor, store = started(keyed.FirstSeen(1000))
    pushed(processor, ("s", "u"), entries([(p, T0 + i, i, p, T0 + i) for i, p in enumerate("abcd")]))
    assert store.calls <= 3
    rows = passed(processor, store, ("s", "u"), T0 + 10**6)
    assert sorted(r[2:5] for r in rows) == [(p, T0 + i, i) for i, p in enumerate("abcd")]
    assert not store.values and not store.timers


def test_quiet_counts_from_the_latest_entry():
    """Later entries that came while the first was still held keep the mark up as well."""
    processor, store = started(keyed.FirstSeen(1000))
    key = ("s", "u")
    pushed(processor, key, entries([("a", T0, 1, "x", T0 + 900)]))
    assert len(passed(processor, store, key, T0 + 500)) == 1
    pushed(processor, key, entries([("a", T0 + 1800, 2, "x", T0 + 1800)]))
    assert passed(processor, store, key, T0 + 2000) == []
    pushed(processor, key, entries([("a", T0 + 5000, 3, "x", T0 + 5000)]))
    assert [r[4] for r in passed(processor, store, key, T0 + 9000)] == [3] and not store.values
