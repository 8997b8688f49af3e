"""The filter audit against loops over all documents, whatever the cut of the files."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spoorlog.llm import interaction as I

DOCS = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def plain(docs, labels):
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), d is not None and d > least[text])) if bad}
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, value = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                value[f] += len(removed)
                out[part, order, step] = [
                    len(left), len(removed), sum(f in r[1] for r in mine) - len(removed), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(value[order[step - 1]])
    return out


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    """Texts with many copies, ids in no order, repeated rows, nulls."""
    rng = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([150, 260, 500]))) for _ in range(12)]
    texts += [" \x0b".join(rng.choices(words[:60], k=230)), "\t" + texts[0].title() + "\n", texts[1] + " 5%", "", " \n ", "Ä" * 400, "A"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(i, "the hot text " * 80, "en") for i in range(400, 500)]
    docs += [docs[3], docs[3], (docs[9][0], docs[9][1], "fr"), (None, docs[0][1], "en"), (None, docs[0][1], None), (700, None, "en"), (701, None, "en")]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 500, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("files, batches", [(1, 4), (6, 6), (6, 2)])
def test_audit_equals_loops(spark, tmp_path, data, files, batches):
    docs, labels = data
    for i in range(files):
        spark.createDataFrame(docs[i::files], DOCS).withColumns({"key": F.lit("mine"), "mask": F.lit(1), "n": F.lit(2)}).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "d"))
    known = spark.createDataFrame(labels, LABELS).withColumn("good", F.lit(9))
    assert got(I.audit(spark, str(tmp_path / "d"), known, batches)) == plain(docs, labels)


def test_retractions_when_smaller_ids_come(spark, tmp_path, data):
    """Files in falling order of ids: every copy was counted as a first one before."""
    docs, labels = data
    ordered = sorted((d for d in docs if d[0] is not None), key=lambda d: -d[0])
    for i in range(5):
        spark.createDataFrame(ordered[i * 90 : (i + 1) * 90], DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    signed = I.stream_masks(spark, str(tmp_path / "d"), 5)
    assert signed.filter("n < 0").count() > 20 and signed.agg(F.sum("n")).first()[0] == len(ordered)
    assert got(I.interactions(I.counters(signed, spark.createDataFrame(labels, LABELS)))) == plain(ordered, labels)


def test_resumed_run_takes_only_new_files(spark, tmp_path, data):
    docs, labels = data
    folder, at = str(tmp_path / "state"), str(tmp_path / "d")
    spark.createDataFrame(docs[:200], DOCS).coalesce(1).write.mode("append").parquet(at)
    I.stream_masks(spark, at, 1, folder)
    spark.createDataFrame(docs[200:], DOCS).coalesce(1).write.mode("append").parquet(at)
    signed = I.stream_masks(spark, at, 1, folder)
    assert got(I.interactions(I.counters(signed, spark.createDataFrame(labels, LABELS)))) == plain(docs, labels)
    assert I.stream_masks(spark, at, 1, folder).agg(F.sum("n")).first()[0] == len(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "d"))
    assert got(I.audit(spark, str(tmp_path / "d"), spark.createDataFrame([], LABELS))) == {}
