import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorlog.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.DEFAULT_MODEL), reason="no tokenizer files")
TEXTS = ["", " ", "The quick brown fox", "  two  spaces  ", "tabs\tand\nlines\r\n", "日本語 \U0001f600 \u0000", "ein Übergrößenträger", "x" * 300, " " * 90 + "y"]


def split(encoder, texts):
    out = []
    for ids, cuts in encoder.encode(texts, np.arange(len(texts))):
        out += [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def test_without_dropout_it_is_the_models_own_segmentation():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)
    assert split(P.Encoder(dropout=0.0), TEXTS) == [model.encode(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("theain  ▁é日\n\\<\u0000\U0001f600")), max_size=60), max_size=6), st.sampled_from([0.0, 0.1, 0.6, 1.0]))
def test_round_trip(texts, dropout):
    encoder = P.Encoder(dropout=dropout, seed=3)
    for ids, cuts in encoder.encode(texts, np.arange(len(texts))):
        assert encoder.decode(ids, cuts) == texts


def test_arrays_and_heap_agree():
    vocab, rng = P.vocabulary(P.DEFAULT_MODEL), random.Random(2)
    for _ in range(200):
        unit = " " + "".join(rng.choice("thearoinsé▁q") for _ in range(rng.randint(0, 30)))
        symbols = vocab.symbols(np.array([ord(c) for c in unit], np.uint32))
        key = np.array([rng.getrandbits(64)], np.uint64)
        for dropout in (0.0, 0.3):
            ids, alive = P.merge_all(vocab, symbols, np.array([0]), key, dropout)
            own, left = P.agenda(vocab, symbols, key[0], dropout)
            assert ids[alive].tolist() == own and np.flatnonzero(alive).tolist() == left


def test_dropout_varies_and_repeats():
    text = "internationalisation of standardised measurements " * 20
    a, b = (split(P.Encoder(dropout=0.2, seed=s), [text])[0] for s in (1, 2))
    assert a != b and a == split(P.Encoder(dropout=0.2, seed=1), [text])[0]
    plain = split(P.Encoder(dropout=0.0), [text])[0]
    assert len(a) > len(plain)
    one, two = split(P.Encoder(dropout=0.2), [text, text])
    assert one != two  # the same text in two documents


def test_documents_round_trip(docs):
    encoder = P.Encoder()
    out = P.encode_documents(docs([*TEXTS, None]), encoder)
    rows = out.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in P.decode_documents(out, encoder).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))


def test_every_occurrence_draws_for_itself():
    cuts = split(P.Encoder(dropout=0.3), ["internationalisation " * 400 for _ in range(2)])
    vocab = P.vocabulary(P.DEFAULT_MODEL)
    spelled = ["\0".join(vocab.spelled[vocab.spell_at[i] : vocab.spell_at[i + 1]].tobytes().decode() for i in ids) for ids in cuts]
    assert len({w for s in spelled for w in s.split(" ")}) > 50


def test_cached_segmentations_change_nothing():
    texts = [" ".join(random.Random(s).choices(["the", "station", "measurement", "q" * 60, "überall", "\U0001f600x"], k=200)) for s in range(3)]
    encoder = P.Encoder(dropout=0.1, seed=4)
    cached = split(encoder, texts)
    encoder._skipping = lambda merges, n, which, keys: np.arange(len(which))
    assert split(encoder, texts) == cached


def test_copies_are_cut_apart(docs):
    df = docs([(7, "internationalisation of standardised measurements " * 20)] * 3 + [(8, "other")])
    for copies, n in ((False, 1), (True, 3)):
        out = P.encode_documents(df, P.Encoder(), copies=copies).collect()
        assert len({tuple(r.ids) for r in out if r.doc_id == 7}) == n and all(r.lossless for r in out) and len(out) == 4
