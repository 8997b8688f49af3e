"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from spoorlog.llm import (
    chat,
    langid,
    mixing,
    order_minhash,
    pieces,
    quality,
    secret_scan,
    spotsigs,
    suffix_dedup,
    toxicity,
)

LONG = "the quick brown fox said that " * 4000
ROWS = [
    (1, "A plain text of the usual kind, with a few words in it.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \n\t ", "de", "b"),
    (5, LONG, "en", "a"),
    (5, LONG, "en", "a"),
    (6, "A plain text of the usual kind, with a few words in it.", None, "c"),
    (None, "Ein Text ohne Nummer, aber mit Worten darin.", "de", None),
    (None, None, None, None),
    (7, "x" * 3000, "fr", "c"),
    (8, "▁ \\ <|im_end|> 日本語 \U0001f600 İ ſ \u0000 tail ", "fr", "c"),
]
LABELS = "doc_id bigint, quality int, toxic int"


def clashing(df):
    """The same rows with columns that operators use inside."""
    for name in ("key", "node", "row", "size", "copies", "draw", "keys", "doc", "start", "words", "bucket", "label", "of", "spans"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], LABELS)


def per_row(labels):
    profiles = langid.Profiles([], __import__("numpy").zeros((0, 64), "f4"), 64, 7)
    return {
        "language": lambda d: langid.predict(d, langid.train(d, dim=256)),
        "no language": lambda d: langid.predict(d, profiles),
        "secrets": secret_scan.find_secrets,
        "masked": secret_scan.mask_secrets,
        "spots": spotsigs.fingerprints,
        "neighbours": spotsigs.with_neighbours,
        "quality": lambda d: quality.judge(d, labels),
        "mix": mixing.take,
        "toxicity": lambda d: toxicity.predict(d, toxicity.train(d, labels)),
        "near": order_minhash.classes,
        "pieces": lambda d: pieces.encode_documents(d, pieces.Encoder()),
    }


NAMES = list(per_row(None))


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each(name, docs, labels):
    fn = per_row(labels)[name]
    got = fn(clashing(docs(ROWS))).collect()
    assert len(got) == len(ROWS)
    ids = sorted(str(r["doc_id"]) for r in got)
    assert ids == sorted(str(r[0]) for r in ROWS)
    long = [r.asDict() for r in got if r["doc_id"] == 5]
    assert long[0] == long[1] or name == "neighbours"  # a copy has its copy as neighbour


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, docs, labels):
    assert per_row(labels)[name](docs([])).collect() == []


def test_other_results_of_empty_tables(spark, docs):
    empty = docs([])
    assert suffix_dedup.repeats(empty).collect() == []
    assert order_minhash.keep_one(empty).collect() == []
    assert mixing.mix(empty).collect() == []
    assert spotsigs.similar(spotsigs.fingerprints(empty)).collect() == []
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.formatted(turns)).collect() == []


def test_kept_columns(docs):
    df = clashing(docs(ROWS))
    for out in (langid.keep_accepted(df, langid.train(df, dim=256)), order_minhash.keep_one(df), secret_scan.mask_secrets(df), mixing.mix(df)):
        assert out.columns == df.columns
        rows = out.collect()
        assert {r["row"] for r in rows} <= {"mine"}


def test_repeats_on_edges(docs):
    got = suffix_dedup.repeats(clashing(docs(ROWS))).collect()
    assert got == []  # the long text repeats only in its own copy of the same id
    got = suffix_dedup.repeats(docs([(1, LONG), (2, LONG), (None, LONG), (3, None), (4, "")])).collect()
    n = len(LONG.split())
    assert sorted((str(r.doc_id), r.start_word, r.end_word) for r in got) == [("1", 0, n), ("2", 0, n), ("None", 0, n)]


def test_toxicity_without_labels(docs, labels):
    got = toxicity.predict(docs(ROWS), toxicity.train(docs(ROWS), labels.filter("false"))).collect()
    assert {r.predicted for r in got} == {0} and max(r.score for r in got) < 1e-6
