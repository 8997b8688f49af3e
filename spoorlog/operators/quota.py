"""Which requests went over a sliding quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.operators import sliding
from spoorlog.operators.sliding import bucket_of, covered, crowded

HOUR = 3_600_000
QUOTAS = {"analyze": (20, HOUR), "upload": (10, 24 * HOUR), "report": (5, 24 * HOUR)}
KEYS = ["user_id", "kind"]


def _oldest_in_window(over: DataFrame, requests: DataFrame, width: int, pieces: bool) -> DataFrame:
    """Adds ``oldest``, the first request time in ``[at - width, at]``.

    Looked up from ``at - width`` on, in its bucket and the one behind. Going
    backwards in time, the last request seen is the next one after the probe. Long
    crowded buckets are gone through in pieces; each starts from the first request behind it.
    """
    times = requests.select(*KEYS, "ms").distinct()
    own = bucket_of(F.col("ms"), width)
    none = F.lit(None).cast("bigint")
    marks = times.select(
        *KEYS, F.explode(F.array(own, own - width)).alias("bucket"),
        F.col("ms").alias("place"), F.col("ms").alias("seen"), none.alias("at"), none.alias("value"),
    )
    probe = F.col("at") - width
    probes = over.select(
        *KEYS, bucket_of(probe, width).alias("bucket"), probe.alias("place"), none.alias("seen"),
        "at", "value",
    )
    rows, parts = marks.unionByName(probes), [*KEYS, "bucket"]
    if pieces:
        rows = sliding.carried_in(rows, parts, "place", F.min("seen"), {"seen": F.min("part")}, back=True)
        parts = [*parts, "piece"]
    back = (
        Window.partitionBy(*parts)
        .orderBy(F.desc("place"), F.col("at").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("oldest", F.last("seen", ignorenulls=True).over(back))
        .filter(F.col("at").isNotNull())
        .select(*KEYS, "at", "value", "oldest")
    )


def quota_audit(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Requests beyond ``limit`` per user and kind in the trailing window.

    ``requests`` has ``user_id``, ``kind`` and ``ms`` plus any other columns, which
    are kept. The count is exact and includes the request itself.
    ``retry_after`` is the time until the oldest request leaves the window, in
    whole seconds.
    """
    counted = requests.groupBy(*KEYS, "ms").agg(F.count(F.lit(1)).alias("weight"))
    spans = counted.select(
        *KEYS, F.col("ms").alias("start"), (F.col("ms") + window_ms).alias("stop"),
        F.col("ms").alias("at"), "weight",
    )
    pieces = crowded(counted, KEYS, window_ms)
    over = covered(spans, KEYS, window_ms, pieces=pieces).filter(F.col("value") > limit)
    timed = _oldest_in_window(over, requests, window_ms, pieces)
    seconds = F.ceil((F.col("oldest") + window_ms - F.col("ms")) / 1000)
    return (
        requests.join(timed.withColumnRenamed("at", "ms"), [*KEYS, "ms"])
        .withColumn("retry_after", F.greatest(seconds, F.lit(0)).cast("bigint"))
        .withColumnRenamed("value", "in_window")
        .drop("oldest")
    )


def quota_report(requests: DataFrame, quotas: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """:func:`quota_audit` for every kind with its own limit and window."""
    parts = [
        quota_audit(requests.filter(F.col("kind") == kind), limit, window)
        for kind, (limit, window) in (quotas or QUOTAS).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
