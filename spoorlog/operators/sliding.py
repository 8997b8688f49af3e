"""Sliding event-time windows that hold up when one key has most of the rows.

A window ``[t, t + W]`` anchored at every row is never built row by row. A row
at time ``m`` counts for every anchor in ``[m - W, m]``, so the window value at
an anchor is the number of such spans covering it: a running sum of +1 at each
span's start and -1 behind its end.

Time is cut into buckets of length W. A span reaches into at most two of them
and is clipped at their edge, so every (key, bucket) is summed on its own. Rows
are merged per millisecond, map side first, before the sort.

A bucket of a long window is summed in pieces of ten minutes: the totals of the
pieces, one small row each, run up first, and each piece starts from the total
carried into it. So a task sorts the milliseconds of ten minutes at most, however
long the window and however many rows share a key, a bucket or even one instant. Where
:func:`crowded` finds no bucket of a key with that many rows, whole buckets are sorted,
which spares the shuffles that carry totals from piece to piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_MS = 600_000
#: Rows of one key in one bucket that a task may sort.
CROWD = 100_000


def bucket_of(ms: Column, width: int) -> Column:
    """Start of the bucket that holds ``ms``."""
    return ms - F.pmod(ms, F.lit(width).cast("bigint"))


def crowded(rows: DataFrame, keys: list[str], width: int) -> bool:
    """Whether a bucket of some key has more rows than a task should sort at once; one number is read."""
    if width <= PIECE_MS:
        return False
    counts = rows.groupBy(*keys, bucket_of(F.col("ms"), width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) > CROWD


def carried_in(
    rows: DataFrame, parts: list[str], place: str, total: Column, carried: dict[str, Column], back: bool = False
) -> DataFrame:
    """Rows with their ``piece``, and one more per piece that brings in what lies before it.

    ``rows`` are grouped by ``parts`` and ordered by ``place``. ``total`` is what a
    piece adds, an aggregate; its value over all earlier pieces of the group, by the
    same aggregate (``running`` in ``carried``), fills the fields of the carried row,
    which lies just before its piece. With ``back`` the order runs downwards, and
    the carried row lies just behind.
    """
    cut = rows.withColumn("piece", bucket_of(F.col(place), PIECE_MS))
    sums = cut.groupBy(*parts, "piece").agg(total.alias("part"))
    order = F.desc("piece") if back else F.asc("piece")
    before = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.col("piece") + (PIECE_MS if back else -1)
    fields = {place: edge, **{name: value.over(before) for name, value in carried.items()}}
    more = sums.select(*parts, "piece", *[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cut.schema.fields if f.name not in (*parts, "piece")])
    return cut.unionByName(more.filter(F.coalesce(*[F.col(name) for name in carried]).isNotNull()))


def covered(
    spans: DataFrame, keys: list[str], width: int, one_per_point: bool = True, pieces: bool = True
) -> DataFrame:
    """Total weight of the spans covering each evaluation point.

    ``spans`` has the keys, ``start`` and ``stop`` (inclusive, at most ``width``
    apart), ``weight``, and ``at``, the point to evaluate. One row per key and
    distinct point. Spans that share a point are merged per millisecond before
    the sort unless the caller has one span per point already. Without ``pieces``
    a bucket is sorted whole.
    """
    first, last = bucket_of(F.col("start"), width), bucket_of(F.col("stop"), width)
    behind = F.col("stop") + 1
    none = F.lit(None).cast("bigint")

    def step(bucket: Column, at: Column, delta: Column, point: bool) -> Column:
        return F.struct(
            bucket.alias("bucket"), at.alias("at"), delta.alias("delta"), F.lit(point).alias("point")
        )

    weight = F.col("weight").cast("bigint")
    steps = F.array(
        step(first, F.col("start"), weight, False),
        step(F.when(last > first, last).otherwise(none), last, weight, False),
        step(F.when(bucket_of(behind, width) == last, last).otherwise(none), behind, -weight, False),
        step(bucket_of(F.col("at"), width), F.col("at"), F.lit(0).cast("bigint"), True),
    )
    moves = spans.select(*keys, F.inline(steps)).filter(F.col("bucket").isNotNull())
    if not one_per_point:
        moves = moves.groupBy(*keys, "bucket", "at").agg(
            F.sum("delta").alias("delta"), F.max("point").alias("point")
        )
    parts = [*keys, "bucket"]
    if pieces and width > PIECE_MS:
        moves = carried_in(moves, parts, "at", F.sum("delta"), {"delta": F.sum("part")})
        parts = [*parts, "piece"]
    running = Window.partitionBy(*parts).orderBy("at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        moves.withColumn("value", F.sum("delta").over(running))
        .filter("point")
        .select(*keys, "at", "value")
    )


def count_spans(rows: DataFrame, keys: list[str], width: int, weight: str | None = None) -> DataFrame:
    """One weighted span per key and distinct millisecond; ``weight`` is the rows a row stands for, one if None."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = rows.groupBy(*keys, "ms").agg(n.alias("weight"))
    return counted.select(
        *keys, (F.col("ms") - width).alias("start"), F.col("ms").alias("stop"),
        F.col("ms").alias("at"), "weight",
    )


def distinct_spans(rows: DataFrame, keys: list[str], width: int, value: str, pieces: bool = True) -> DataFrame:
    """Spans that cover each anchor once per distinct ``value`` in its window.

    A repeated value starts its span behind the previous sighting, so its spans
    never overlap. Only a sighting less than W back matters; it lies in the same
    bucket or the one before, which bounds this window too.
    """
    width_ms = F.lit(width).cast("bigint")
    own = bucket_of(F.col("ms"), width)
    seen = rows.select(*keys, value, "ms").distinct()
    looked = seen.withColumn("bucket", F.explode(F.array(own, own + width_ms)))
    parts = [*keys, value, "bucket"]
    if pieces and width > PIECE_MS:
        # The carried row is a sighting itself: the last one of the pieces before.
        looked = looked.withColumns({"place": F.col("ms"), "real": F.lit(True)})
        looked = carried_in(looked, parts, "place", F.max("ms"), {"ms": F.max("part")})
        parts = [*parts, "piece"]
        previous = F.lag("ms").over(Window.partitionBy(*parts).orderBy("place"))
        looked = looked.withColumn("previous", previous).filter("real")
    else:
        previous = F.lag("ms").over(Window.partitionBy(*parts).orderBy("ms"))
        looked = looked.withColumn("previous", previous)
    return (
        looked.filter(F.col("bucket") == own)
        .select(
            *keys, F.greatest(F.col("ms") - width, F.col("previous") + 1).alias("start"),
            F.col("ms").alias("stop"), F.col("ms").alias("at"), F.lit(1).alias("weight"),
        )
    )


def busy_rows(rows: DataFrame, keys: list[str], width: int, threshold: int, weight: str | None = None) -> DataFrame:
    """The rows that can lie in a window of more than ``threshold`` rows.

    A window anchored in a bucket reaches into that bucket and the next, so the
    two counts together bound its value. The counts merge on the map side and
    the buckets that pass are few in ordinary logs; all other rows end here.
    ``weight`` is the number of rows that a row stands for.
    """
    width_ms = F.lit(width).cast("bigint")
    own = bucket_of(F.col("ms"), width)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(*keys, own.alias("bucket")).agg(n.alias("n"))
    reached = counts.select(
        *keys, F.explode(F.array(F.col("bucket"), F.col("bucket") - width_ms)).alias("bucket"), "n"
    )
    anchors = reached.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    busy = anchors.filter(F.col("n") > threshold).select(
        *keys, F.explode(F.array(F.col("bucket"), F.col("bucket") + width_ms)).alias("bucket")
    )
    kept = rows.withColumn("bucket", own).join(busy, [*keys, "bucket"], "left_semi")
    return kept.drop("bucket")


def sliding_window_max(
    rows: DataFrame, keys: list[str], width: int, threshold: int, distinct: str | None = None, weight: str | None = None,
    pieces: bool = True,
) -> DataFrame:
    """The first window with the greatest value per key, if above ``threshold``.

    ``rows`` has the keys and ``ms``. The value of a window is its row count, or
    its number of distinct ``distinct`` values. ``weight`` is the number of rows that
    a row stands for. Without ``pieces`` buckets are sorted whole.
    """
    spans = (
        count_spans(rows, keys, width, weight)
        if distinct is None
        else distinct_spans(rows, keys, width, distinct, pieces)
    )
    best = F.max(F.struct("value", (-F.col("at")).alias("earliest")))
    return (
        covered(spans, keys, width, one_per_point=distinct is None, pieces=pieces)
        .filter(F.col("value") > threshold)
        .groupBy(*keys)
        .agg(best.alias("best"))
        .select(*keys, F.col("best.value").alias("value"), (-F.col("best.earliest")).alias("anchor"))
    )


def rows_in_window(rows: DataFrame, anchors: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The rows inside each anchor's window, with ``anchor`` and ``value``.

    An equi-join on key and bucket with a range check behind it: an anchored
    window lies in two buckets at most.
    """
    width_ms = F.lit(width).cast("bigint")
    own = bucket_of(F.col("anchor"), width)
    reach = anchors.withColumn("bucket", F.explode(F.array(own, own + width_ms)))
    inside = F.col("ms").between(F.col("anchor"), F.col("anchor") + width_ms)
    return (
        rows.withColumn("bucket", bucket_of(F.col("ms"), width))
        .join(reach, [*keys, "bucket"])
        .filter(inside)
        .drop("bucket")
    )


def first_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key; the filter also runs before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)
