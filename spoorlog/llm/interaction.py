"""How filters of a corpus interact, by an incremental stream with retractions.

Files of documents arrive as micro-batches of an available-now stream. A document
becomes a narrow row: its part, a mask of the filters it fails and a digest of its
text. State keyed by the digest holds the least id seen with that text and what
was counted for it. A greater id fails the filter of copies; a smaller one takes
the place of the least, and what had been counted for that is retracted and
counted again with the filter failed. The sum of all signed rows is the same
whatever the order and the cut of the files.

Before the shuffle, copies inside an Arrow batch that are not its least are
settled: they fail whatever comes, so only one row per text and batch reaches the
state, and a text with a third of all rows costs no more than others.

State is a table in the shared folder, one version per micro-batch, each made from
the one before it and the batch by one shuffle on the digest. A batch that is
repeated writes the same version again. (The store of Spark's own stateful
operators gives the same rows, but calls Python once per text and keeps a database
per partition; see the README for what that took.)
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoorlog.session import shared_dir, staged

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BATCHES = 4
ROW = "key binary, doc_id bigint, part string, mask int, n bigint"
JUDGED = ROW + ", old boolean, least bigint"
SIGNED = ["doc_id", "part", "mask", "n"]


def masked(docs: DataFrame) -> DataFrame:
    """key, doc_id, part, mask: digest of the text and bits of the filters A to D that it fails.

    Null texts are empty; a null lang is the part ''.
    """
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    inner = F.btrim("body", F.lit(" \t\n\x0b\f\r"))
    counted = read.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("key"),
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+")).alias("words"),
        F.length("body").alias("n_chars"), F.length(F.regexp_replace("body", "[^A-Z]+", "")).alias("n_capitals"),
        F.col("body").rlike(r"[#$%&*|]").alias("symbols"))
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = (n_words < 200, n_distinct * 100 < n_words * 50, F.col("n_capitals") * 100 > F.col("n_chars") * 3, F.col("symbols"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return counted.select("key", "doc_id", "part", bits.cast("int").alias("mask"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with their number; rows that need no state without a digest.

    These are copies of a smaller id in the batch, which fail the filter of copies,
    and rows without id, which never do.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pd.DataFrame({
            "key": batch.column(0).to_pylist(), "doc_id": batch.column(1).fill_null(0).to_numpy(zero_copy_only=False),
            "part": batch.column(2).to_pylist(), "mask": batch.column(3).to_numpy(zero_copy_only=False),
            "known": batch.column(1).is_valid().to_numpy(zero_copy_only=False)})
        code, distinct = pd.factorize(rows["key"])
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, code[rows["known"]], rows["doc_id"][rows["known"]])
        copy = rows["known"] & (rows["doc_id"] > least[code])
        rows["mask"] |= np.where(copy, COPY, 0)
        rows["code"] = np.where(copy | ~rows["known"], -1, code)
        out = rows.groupby(["code", "doc_id", "part", "mask", "known"], sort=False).size().reset_index(name="n")
        keys = [distinct[c] if c >= 0 else None for c in out["code"]]
        ids = pa.array(out["doc_id"].to_numpy(np.int64), mask=~out["known"].to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), ids, pa.array(out["part"].to_list(), pa.string()),
             pa.array(out["mask"].to_numpy(np.int32)), pa.array(out["n"].to_numpy(np.int64))], ["key", "doc_id", "part", "mask", "n"])


def _judged(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Rows of a batch and of the state before it, with the least id now known of their text."""
    fresh = rows.filter("key IS NOT NULL").withColumn("old", F.lit(False))
    both = fresh if state is None else fresh.unionByName(state.withColumn("old", F.lit(True)))
    summed = both.repartition("key").groupBy("key", "doc_id", "part", "mask", "old").agg(F.sum("n").alias("n"))
    return summed.withColumn("least", F.min("doc_id").over(Window.partitionBy("key"))).select(*[f.split()[0] for f in JUDGED.split(", ")])


def _state(judged: DataFrame) -> DataFrame:
    """What is counted as no copy: the rows of the least id of each text."""
    return judged.filter(F.col("doc_id") == F.col("least")).groupBy("key", "doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def _signed(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: what the batches count, and retract of what earlier ones counted."""
    copy, mask = F.col("doc_id") > F.col("least"), F.col("mask")
    failed = mask.bitwiseOR(F.lit(COPY))
    fresh = judged.filter("NOT old").select("doc_id", "part", F.when(copy, failed).otherwise(mask).alias("mask"), "n")
    change = F.array(F.struct(mask.alias("mask"), (-F.col("n")).alias("n")), F.struct(failed.alias("mask"), F.col("n").alias("n")))
    taken_back = judged.filter(F.col("old") & copy).select("doc_id", "part", F.inline(change)).select(*SIGNED)
    return rows.filter("key IS NULL").select(*SIGNED).union(fresh).union(taken_back)


def stream_masks(spark: SparkSession, path: str, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """doc_id, part, mask, n: signed rows whose sums count the documents of each id, part and mask.

    The files under ``path`` are read in ``batches`` micro-batches of equal numbers
    of files. A run that is resumed with its ``folder`` goes on behind the last batch
    that ended, and takes files that came since.
    """
    whole = spark.read.parquet(path)
    n_files = len(whole.inputFiles())
    base = folder or f"{shared_dir(spark)}/spoorlog/audit-{uuid.uuid4().hex}"
    named = path.rstrip("/")
    named = f"{named[:-1]}[{named[-1]}]"  # a stream takes a pattern for a single file as for a folder
    stream = (
        spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", max(1, math.ceil(n_files / batches))).parquet(named))

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")
        rows = spark.read.schema(ROW).parquet(f"{base}/rows/batch={batch_id}")
        state = _state(spark.read.schema(JUDGED).parquet(f"{base}/judged/batch={batch_id - 1}")) if batch_id else None
        _judged(rows, state).write.mode("overwrite").parquet(f"{base}/judged/batch={batch_id}")

    for kind, schema in (("rows", ROW), ("judged", JUDGED)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/{kind}/batch=-1")
    masked(stream).mapInArrow(_settle, ROW).writeStream.foreachBatch(take).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _signed(spark.read.schema(ROW).parquet(f"{base}/rows"), spark.read.schema(JUDGED).parquet(f"{base}/judged"))


def counters(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask, and those labelled so.

    A document is good or toxic if any of its labels says so. Rows without id have no labels.
    """
    marked = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("of")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = signed.filter("doc_id IS NOT NULL").join(marked, F.col("doc_id") == F.col("of"), "left").select(
        "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = signed.filter("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.sum(c).cast("bigint")
    return named.union(rest).groupBy("part", "mask").agg(
        total("n").alias("n"), total(F.col("n") * F.col("good")).alias("good"), total(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost count documents of
    the part at that step; shapley sums what its filter removes over all orders.
    """
    steps = [
        (order, k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k]))
        for order in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("before"), F.lit(own).alias("own")) for o, k, b, own in steps])
    each = counted.select("part", "mask", "n", "good", "toxic", F.inline(table))
    mask = F.col("mask")
    passed, fails = mask.bitwiseAND(F.col("before")) == 0, mask.bitwiseAND(F.col("own")) != 0
    total = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("bigint")
    by_step = each.groupBy("part", "filter_order", "step", "own").agg(
        total(passed & ~fails, "n").alias("kept"), total(passed & fails, "n").alias("removed"), total(~passed & fails, "n").alias("redundant"),
        total(mask == F.col("own"), "n").alias("unique_fails"), total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"))
    all_orders = staged(by_step, "steps")
    value = all_orders.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return all_orders.join(value, ["part", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The interaction of the five filters over the documents under ``path``.

    A: under 200 words; B: distinct words under half of them; C: capitals A-Z over
    3 % of the code points; D: any of ``#$%&*|``; E: the text of a smaller doc_id.
    Rows without id fail E never and make no other row fail it; rows that repeat
    the least id all pass it. Parts without a document that fails still have all
    their rows; an empty table has none. Columns besides doc_id, text, lang are not read.
    """
    return interactions(staged(counters(stream_masks(spark, path, batches), labels), "counters"))
