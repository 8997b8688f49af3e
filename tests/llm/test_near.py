import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorlog.llm import order_minhash as O
from spoorlog.llm.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


seqs = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=600, deadline=None)
@given(seqs, seqs, st.integers(0, 9))
def test_banded_distance(a, b, most):
    assert O.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(distance(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(seqs, seqs)
def test_parities_bound_the_distance(a, b):
    x, y = (O.parities(np.array(v, np.uint32) * np.uint32(77)) for v in (a, b))
    assert sum((p ^ q).bit_count() if p ^ q >= 0 else ((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True)) <= 2 * distance(a, b)


def test_parities_tell_repeated_words_apart():
    bits = lambda v: O.parities(np.array(v, np.uint32))
    differ = lambda a, b: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(bits(a), bits(b), strict=True))
    line = [1, 2] * 300
    one, two = line + [n for w in range(10, 60) for n in (w, w)], line + [n for w in range(100, 150) for n in (w, w)]
    assert differ(line, line) == 0 and differ(one, one[::-1]) == 0
    assert 170 <= differ(one, two) <= 2 * distance(one, two)  # each word of its own twice, 200 labelled words in all


def test_order_counts():
    rng = random.Random(1)
    words = [rng.getrandbits(64) for _ in range(60)]
    a, b = O.keyed(64)
    one = O.sketches(np.array(words, np.uint64), a, b)
    same = (one == O.sketches(np.array(words, np.uint64), a, b)).mean()
    moved = (one == O.sketches(np.array(words[30:] + words[:30], np.uint64), a, b)).mean()
    assert same == 1 and moved < 0.75  # the same set in another order agrees less


def test_occurrences_are_labelled():
    k = np.array([5, 7, 5, 5, 7], np.uint64)
    assert len(set(O.labelled(k).tolist())) == 5
    assert O.labelled(k)[0] == O.labelled(np.array([5], np.uint64))[0]


def near_copies(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, group = [], []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for c in range(rng.randint(1, 9)):
            words = base[:]
            for _ in range(rng.randint(0, max(1, len(words) // 50))):
                i = rng.randrange(len(words))
                rng.choice([lambda: words.insert(i, "new"), lambda: words.pop(i), lambda: words.__setitem__(i, rng.choice(vocab))])()
            texts.append(" ".join(words) if c % 3 else "  ".join(words).upper())
            group.append(g)
    return texts, group


def brute(texts, least=0.8):
    words = [t.lower().split() for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(words):
        for j in range(i):
            longer = max(len(a), len(words[j]))
            if texts[i] == texts[j] or longer and abs(len(a) - len(words[j])) <= longer * (1 - least) and 1 - distance(a, words[j]) / longer >= least:
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return [top(i) for i in range(len(texts))]


def test_classes_equal_brute_force(docs):
    texts, _ = near_copies()
    texts += [texts[0], texts[5], "", "", None, "short", "SHORT", "other"]
    got = {r.doc_id: r for r in O.classes(docs(texts)).collect()}
    wanted = brute([t or "" for t in texts])
    assert [got[i].class_id for i in range(len(texts))] == wanted
    for i, r in got.items():
        assert r.class_size == wanted.count(wanted[i])


def test_keeps_one_of_each_class(docs):
    texts, _ = near_copies(4)
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "no id here at all"), (None, "another one without"), (None, texts[3])]
    kept = O.keep_one(docs(rows)).collect()
    wanted = sorted(set(brute(texts)))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == wanted
    assert sorted(r.text for r in kept if r.doc_id is None) == ["another one without", "no id here at all"]


@pytest.mark.parametrize("n", [2, 40])
def test_components(spark, n):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(n)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf0"), (b"\xf0", b"\xf0")]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(n + 1)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


@pytest.mark.parametrize("n, similarity, least", [(100, 0.8, 0.9), (300, 0.8, 0.9), (100, 0.85, 0.95), (100, 0.9, 0.95), (25, 0.8, 0.85),
                                                   (20, 0.8, 0.9), (10, 0.8, 0.9), (10, 0.9, 0.95), (5, 0.8, 0.85)])
def test_lone_pairs_at_the_threshold_are_candidates(n, similarity, least):
    rng, pairs = random.Random(5), 120
    texts = []
    for p in range(pairs):
        words = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        edited = words[:]
        for i in rng.sample(range(n), round(n * (1 - similarity))):
            edited[i] = f"x{rng.getrandbits(40)}"
        texts += [" ".join(words), " ".join(edited)]
    keys = [set(k.tolist()) for block in O.band_keys(texts) for k in block]
    assert sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(texts), 2)) >= least * pairs


def test_lone_pairs_are_one_class(docs):
    rng = random.Random(8)
    texts = []
    for n in (5, 10, 30, 100) * 10:
        words = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        edited = words[:]
        for i in rng.sample(range(n), n // 5):
            edited[i] = f"x{rng.getrandbits(40)}"
        texts += [" ".join(words), " ".join(edited)]
    got = {r.doc_id: r.class_id for r in O.classes(docs(texts)).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(texts), 2)) >= 34


def test_a_pair_of_a_crowd_meets_once(docs, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{rng.getrandbits(30)}" if rng.random() < 0.12 else w for w in base) for _ in range(60)]
    met, steps, extended = [], [], O._extended

    def counted(known, pairs, *more):
        met.extend((len(steps), bytes(r.x), bytes(r.y)) for r in pairs.select("x", "y").collect())
        steps.append(1)
        return extended(known, pairs, *more)

    monkeypatch.setattr(O, "_extended", counted)
    got = {r.doc_id: r.class_id for r in O.classes(docs(texts)).collect()}
    assert met and len(met) == len(set(met))
    keys = [set(k.tolist()) for block in O.band_keys(texts) for k in block]
    words = [t.split() for t in texts]
    linked = [(i, j) for i in range(60) for j in range(i) if keys[i] & keys[j] and distance(words[i], words[j]) <= 40]
    assert all(got[i] == got[j] for i, j in linked)  # no link of a shared key is lost
