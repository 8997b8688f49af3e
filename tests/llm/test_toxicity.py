import random

import numpy as np

from spoorlog.llm import toxicity as T
from spoorlog.llm.words import Block

MILD = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]


def text(rng, bad=None):
    sentences = [" ".join(rng.choice(MILD) for _ in range(rng.randint(3, 9))).capitalize() for _ in range(rng.randint(2, 8))]
    place = None
    if bad:
        place = rng.randrange(len(sentences))
        sentences[place] += " " + bad
    return ". ".join(sentences) + ".", place


def data(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.choice(["grubfoo", f"snarl{rng.choice('uvwxyz')}{rng.choice('uvwxyz')}"]) if i % 4 == 0 else None
        out.append((*text(rng, bad), int(bool(bad))))
    return out


def test_finds_toxic_documents_and_sentences(spark, docs):
    train, test = data(800, 1), data(200, 2)
    labels = spark.createDataFrame([(i, 1, y) for i, (_, _, y) in enumerate(train)], "doc_id bigint, quality int, toxic int")
    model = T.train(docs([t for t, _, _ in train]), labels)
    got = {r.doc_id: r for r in T.predict(docs([t for t, _, _ in test]), model).collect()}
    right = sum(got[i].predicted == y for i, (_, _, y) in enumerate(test))
    assert right >= 195
    for i, (t, place, y) in enumerate(test):
        r = got[i]
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if y and r.predicted:
            starts = [0]
            for s in t.split(". ")[:-1]:
                starts.append(starts[-1] + len(s) + 2)
            assert r.worst_at == starts[place] and str(starts[place]) in r.spans.split(",")


def test_noisy_or_of_sentences():
    rng = np.random.default_rng(3)
    model = T.Model(rng.normal(0, 1, 1 << T.BITS), -2.0)
    whole = "One two three. Four! five five six\nseven? ... eight"
    logs, place, owner = model.sentences(Block([whole]))
    assert [whole[p : p + 3] for p in place] == ["One", "Fou", "fiv", "sev", "eig"] and set(owner) == {0}
    for k, s in enumerate(["One two three", "Four", "five six", "seven", "eight"]):
        alone, _, _ = model.sentences(Block([s]))
        assert np.isclose(alone[0], logs[k])


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    feature = rng.integers(0, 50, (600, 3))
    sentence = np.sort(rng.integers(0, 200, 600))
    doc = np.arange(200) // 4
    label = np.array([int((feature[np.isin(sentence, np.flatnonzero(doc == d)), 0] == 7).any()) for d in range(50)])
    model = T.fit(feature, sentence, doc, label, 1, rounds=200, lasso=0)
    z = np.bincount(sentence, model.weights[feature].sum(1), minlength=200) + model.bias
    score = -np.expm1(np.bincount(doc, -np.logaddexp(0, z), minlength=50))
    assert ((score >= 0.5) == label).mean() > 0.95


def test_thinned_labels_keep_their_prior():
    label = np.arange(200) % 2
    weight = np.where(label == 1, 0.2, 1.8)  # toxic 1 in 10 before a sample of equal numbers
    model = T.fit(np.arange(600).reshape(200, 3), np.arange(200), np.arange(200), label, 3, rounds=300, weight=weight)
    assert abs(1 / (1 + np.exp(-model.bias)) - 0.1) < 0.04
    plain = T.fit(np.arange(600).reshape(200, 3), np.arange(200), np.arange(200), label, 3, rounds=300)
    assert abs(1 / (1 + np.exp(-plain.bias)) - 0.5) < 0.1
