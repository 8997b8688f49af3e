import hashlib
import random

import numpy as np
import pytest

from spoorlog.llm import spotsigs as S
from spoorlog.llm.words import Block

VOCAB = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(S.ANCHORS) if rng.random() < 0.4 else rng.choice(VOCAB) for _ in range(n))


def chains(text):
    """Signatures as tuples of words."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    anchors = set(S.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            chain = [x for x in words[i:] if x not in anchors][: S.CHAIN]
            if chain:
                out.add((w, *chain))
    return out


def test_signatures_are_chains_behind_anchors():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)] + ["the", "word", "the of and"]
    sets = S.signatures(Block(texts))
    for text, sigs in zip(texts, sets, strict=True):
        assert len(sigs) == (len(chains(text)) or bool(text.split()))
    for i in range(0, 60, 7):
        for j in range(0, 60, 5):
            a, b = chains(texts[i]), chains(texts[j])
            if a and b:
                assert S.likeness(sets[i], sets[j]) == pytest.approx(len(a & b) / len(a | b))


def test_fingerprint_text_round_trip():
    sigs = np.array([0, 5, 2**32 - 1], np.uint32)
    assert S.from_text(S.as_text(sigs)).tolist() == sigs.tolist()


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_neighbours(docs, ranges):
    rng = random.Random(9)
    rows = [(i * 3, prose(rng, rng.randint(0, 40))) for i in rng.sample(range(300), 50)]
    rows += [(rows[0][0], "tie one"), (rows[0][0], "tie two"), (None, "no id"), (None, None)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = S.with_neighbours(docs(rows), ranges).collect()
    assert len(got) == len(rows)
    wanted = set()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        q = len(a) // 4
        wanted.add((i, len(a), hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == wanted
    for r in got:
        assert r.near_edited == pytest.approx(S.likeness(S.from_text(r.fingerprint), S.from_text(r.edited_fingerprint)))


def test_similar_equals_all_pairs(docs):
    rng = random.Random(2)
    base = [prose(rng, 80) for _ in range(12)]
    texts = list(base)
    for t in base:
        for k in (1, 2, 5):
            words = t.split()
            for _ in range(k):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            texts.append(" ".join(words))
    texts += base[:3]
    prints = S.fingerprints(docs(texts))
    found = {(r.fingerprint_a, r.fingerprint_b): r.likeness for r in S.similar(prints, 0.8).collect()}
    unique = sorted({r.fingerprint for r in prints.collect()})
    wanted = {}
    for i, a in enumerate(unique):
        for b in unique[i + 1 :]:
            score = S.likeness(S.from_text(a), S.from_text(b))
            if score >= 0.8:
                wanted[a, b] = score
    assert wanted and found == pytest.approx(wanted)
