import random

import numpy as np
import pytest

from spoorlog.llm import suffix_dedup as S


def brute(texts, least):
    """Places of words that lie in a run of ``least`` words another document has too."""
    words = [t.lower().split() for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                out.setdefault(d, set()).update(range(i, i + least))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [some(rng.randint(45, 90)) for _ in range(8)]
    texts = []
    for _ in range(80):
        words = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            words += rng.choice(passages) + some(rng.randint(0, 30))
        texts.append(" ".join(words))
    texts += [texts[3], texts[4] + " tail", " ".join(["same"] * 200), "x " + " ".join(["same"] * 130), " ".join(["a", "b"] * 60), "b " + " ".join(["a", "b"] * 40)]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(docs, seed):
    texts = corpus(seed)
    got = {}
    for r in S.repeats(docs(texts)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute(texts, 50)


def test_first_occurrence(docs):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.random()}" for _ in range(70))
    rows = [(i, f"own{i} {passage} end{i}") for i in (9, 4, 7)]
    got = {r.doc_id: r for r in S.repeats(docs(rows)).collect()}
    assert {k: (r.start_word, r.end_word) for k, r in got.items()} == {i: (1, 71) for i in (4, 7, 9)}
    assert got[4].first and not (got[7].first and got[9].first)


def test_equal_passages_keep_equal_places():
    rng = random.Random(7)
    passage = [rng.getrandbits(64) for _ in range(50)]
    for _ in range(50):
        before, after = ([rng.getrandbits(64) for _ in range(rng.randint(0, 60))] for _ in range(2))
        at = S.kept_places(np.array(before + passage + after, np.uint64), S.SPAN) - len(before)
        inside = at[(at >= 0) & (at <= 50 - (S.LEAST - S.SPAN + 1))]
        assert len(inside) and inside[0] < S.SPAN
        inner = [a for a in inside if S.SPAN <= a <= 20]
        assert set(inner) <= set(at.tolist())


def test_least_of_windows():
    x = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    for width in (1, 2, 3, 5, 6):
        assert S.window_least(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


@pytest.mark.parametrize("n", [50, 60, 74])
def test_one_of_many_holders_is_first(docs, n):
    rng = random.Random(n)
    some = lambda k: " ".join(f"w{rng.getrandbits(30)}" for _ in range(k))
    passage = some(n)
    rows = [(i, f"{some(rng.randint(0, 40))} {passage} {some(rng.randint(0, 40))}") for i in rng.sample(range(10**6), 300)]
    got = S.repeats(docs(rows)).collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.first] == [min(i for i, _ in rows)]


@pytest.mark.parametrize("seed", [4, 5])
def test_first_equals_brute_force(docs, seed):
    texts = corpus(seed)
    words = [t.lower().split() for t in texts]
    lowest = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            lowest.setdefault(tuple(w[i : i + 50]), d)
    for r in S.repeats(docs(texts)).collect():
        runs = [tuple(words[r.doc_id][i : i + 50]) for i in range(r.start_word, r.end_word - 49)]
        assert r.first == all(lowest[x] == r.doc_id for x in runs)
