"""Mixing sources to target weights, with Spark expressions.

The size of a document is its number of words. Sources in order of code points
(null last) weigh 1, 2, 3, repeating, and share the sum of all sizes; no source
gets more than ``most`` times its own size, and what that leaves is shared anew
by weight among the rest. A document is taken floor(rate) times, rate being its
source's target over its size, and once more with the fraction as probability:
the draw hashes seed and id, so reruns agree. Rows with one id draw alike.

Sizes are summed map-side per source, so a hot source is no group anywhere; only
the share level, one number a round, reaches the driver, however many sources
there are. Null or blank texts have size 0 and are drawn like others. A source
of size 0 has target 0 and rate 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.session import staged

WORD = r"[^ \t\n\x0B\f\r]+"
MOST = 3.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw_of(doc_id: Column, seed: int) -> Column:
    """A number from 0 to below 1, from the first 32 bits of md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 in order of ``source``, null last: places within sorted ranges plus the ranges' running sizes."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    sorted_ = sources.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = staged(sorted_, "mix-sources").withColumn("range", F.shiftright("place", 33))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    return rows.join(starts, "range").select(
        "source", "source_size", (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    table = staged(ranked(sources).withColumn("weight", (F.col("rank") % 3 + 1).cast("bigint")).drop("rank"), "mix-weights")
    level, full = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size") if full >= 0 else F.lit(False)
        row = table.agg(
            F.sum("source_size").alias("total"), F.count_if(capped).alias("full"),
            F.sum(F.when(capped, F.col("source_size"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("free")).first()
        if row["full"] == full or not row["free"] or not row["total"]:
            break
        full, level = row["full"], (row["total"] - most * (row["held"] or 0)) / row["free"]
    share = F.least(F.lit(level) * F.col("weight"), F.lit(most) * F.col("source_size"))
    return table.select("source", "source_size", share.cast("double").alias("target"))


def copies_of(size_draw: Column) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + (size_draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def take(docs: DataFrame, most: float = MOST, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken; one row per input row."""
    rows = staged(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
            size_of(F.col("text")).alias("size"), draw_of(F.col("doc_id"), seed).alias("draw")), "mix-sizes")
    goal = staged(targets(rows, most), "mix-targets")
    joined = rows.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", copies_of(F.col("draw"))).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mixture itself: rows of ``docs``, all columns, as many times as they are taken."""
    sizes = docs.select(F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    goal = staged(targets(sizes, most), "mix-targets")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("source").cast("string").alias("of"), draw_of(F.col("doc_id"), seed).alias("draw"))
    joined = rows.join(goal, F.col("of").eqNullSafe(F.col("source")))
    times = joined.select("row", copies_of(F.col("draw")).cast("int").alias("copies")).filter("copies > 0")
    return times.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")
