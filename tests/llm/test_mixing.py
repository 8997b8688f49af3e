import hashlib
import math
import re

import pytest

from spoorlog.llm import mixing as M


def goals(sizes, most=3.0):
    """Targets by sharing the excess round after round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    full = set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12)} - full
        if not over:
            return target
        full |= over


def rows():
    out, i = [], 0
    for source, n in (("a", 3), ("b", 400), ("c", 90), ("\U0001f600", 40), ("é", 200), (None, 60), ("Z", 1), ("empty", 4)):
        for _ in range(n):
            text = None if source == "empty" else " ".join(["w"] * (i * 37 % 90))
            out.append((i, text, None, source))
            i += 1
    return out


def test_targets_and_copies(docs):
    data = rows()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data}
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    target = goals(sizes)
    got = {r.doc_id: r for r in M.take(docs(data)).collect()}
    for doc_id, _, _, source in data:
        r = got[doc_id]
        assert r.size == size[doc_id] and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source])
        rate = target[source] / sizes[source] if sizes[source] else 0
        draw = int(hashlib.md5(f"11:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.copies == math.floor(rate) + (draw < rate - math.floor(rate))
        assert r.taken == r.copies * r.size <= 3 * r.size
    again = {r.doc_id: r.taken for r in M.take(docs(data)).collect()}
    assert again == {k: r.taken for k, r in got.items()}


def test_taken_comes_near_target(docs):
    data = [(i, "w " * 50, None, "ab"[i % 5 == 0]) for i in range(3000)]
    taken, target = {}, {}
    sources = {r[0]: r[3] for r in data}
    for r in M.take(docs(data)).collect():
        taken[sources[r.doc_id]] = taken.get(sources[r.doc_id], 0) + r.taken
        target[sources[r.doc_id]] = r.target
    for s in "ab":
        assert taken[s] == pytest.approx(target[s], rel=0.1)


def test_mixture_repeats_rows(docs):
    df = docs(rows())
    times = {r.doc_id: r.copies for r in M.take(df).collect() if r.copies}
    seen = {}
    for r in M.mix(df).collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == times
