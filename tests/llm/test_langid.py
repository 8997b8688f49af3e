import numpy as np

from spoorlog.llm import langid
from spoorlog.llm.words import Block

TRAIN = {
    "en": ["the house on the hill is old and the road to it is long", "she was reading that book with the others", "this is what they said about the weather"],
    "de": ["das haus auf dem hügel ist alt und der weg dorthin ist lang", "sie hat das buch mit den anderen gelesen", "das ist was sie über das wetter sagten"],
}


def vector(text, dim=256, seed=7):
    """Bundled trigrams of one text, one by one."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " "
    out = np.zeros(dim, np.int64)
    at = lambda c: langid.letter_vector(0 if c == " " else ord(c), dim, seed).astype(np.int64)
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        out += np.roll(at(a), 2) * np.roll(at(b), 1) * at(c)
    return out


def test_vectors_are_bundles_of_bound_letters():
    texts = ["Hello, world!", "", "a", "...", "Ünïcode  and\nlines", "x y"]
    got, letters = langid.text_vectors(Block(texts), 256, 7)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    for text, row, n in zip(texts, got, letters, strict=True):
        if n:
            assert row.astype(int).tolist() == vector(text).tolist()


def test_predicts_held_out_sentences(docs):
    train = docs([(i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in TRAIN.items() for t in ts)])
    profiles = langid.train(train)
    assert profiles.langs == ["de", "en"]
    got = langid.predict(docs(["the other road and the old book", "der andere weg und das alte buch", "123 ...", None]), profiles).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got) and got[2].score == 0


def test_keeps_short_texts_and_drops_what_no_language_explains(docs):
    profiles = langid.train(docs([(i, t * 3, lang, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in TRAIN.items() for t in ts)]))
    rows = ["Avec.", "the old book", "12 34", "щжю чыъ фхц " * 30]
    assert [r.text for r in langid.keep_accepted(docs(rows), profiles).collect()] == rows[:2]


def test_nothing_is_rejected_without_profiles(docs):
    rows = docs([(i, "some words of a language that nobody has told us about " * 5, None, None) for i in range(20)] + [(30, "123", None, None)])
    assert langid.keep_accepted(rows, langid.train(rows)).count() == 20


def test_letters_of_every_plane_are_letters(docs):
    profiles = langid.train(docs([(i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in TRAIN.items() for t in ts)]))
    rows = ["\U00020000\U0002a6d6\U0002b740", "\U00031350\U000323af", "\U000e0100\U0010ffff", "\U0001f600"]
    assert [r.lang_pred == "und" for r in langid.predict(docs(rows), profiles).collect()] == [False, False, True, True]
