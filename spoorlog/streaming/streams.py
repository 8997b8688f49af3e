"""Parsers and rules over streams.

State is bounded by event time: every stateful step has a watermark, and rows
later than it are dropped. Counts are merged on the map side before they reach
the state, so a key with most of the rows costs its distinct instants only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoorlog.functions import predicates as is_
from spoorlog.functions.text import non_empty
from spoorlog.operators.parsers import parse_with_format
from spoorlog.operators.rules import rule_off_hours_access
from spoorlog.sources import tables
from spoorlog.streaming.keyed import state_store, stream_windows


def read_log_stream(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Lines of log files as they arrive. Sniffing needs whole files, so the
    format is given, and lines carry no number."""
    lines = spark.readStream.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("session_id"),
        F.lit(None).cast("bigint").alias("line_num"),
        F.regexp_replace("value", r"\r\z", "").alias("raw_line"),
        F.lit(fmt).alias("format"),
    )


def stream_parse(lines: DataFrame, default_year: int) -> DataFrame:
    """``log_entries`` from lines with a ``format`` column."""
    return parse_with_format(lines, default_year)


def stream_rule_counts(
    entries: DataFrame, when: Column, threshold: int, window: str = "5 minutes",
    slide: str = "1 minute", lateness: str = "10 minutes",
) -> DataFrame:
    """Matching entries per address in hopping windows, above a threshold."""
    counts = (
        entries.withWatermark("ts", lateness)
        .filter(when)
        .groupBy("session_id", "ip", F.window("ts", window, slide))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.filter(F.col("count") > threshold).select(
        "session_id", "ip", F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "count"
    )


def stream_brute_force_exact(
    entries: DataFrame, when: Column, threshold: int, width_ms: int = 300_000,
    lateness: str = "10 minutes",
) -> DataFrame:
    """The exact anchored window of the batch rule, once per bucket of time.

    One row comes out per address and bucket in excess, when the watermark closes it;
    the greatest over the buckets is the batch result. :func:`keyed.stream_windows`
    has the alerts on the exceeding rows besides.
    """
    closed = stream_windows(entries, when, threshold, width_ms, lateness).filter(F.col("kind") == "window")
    return closed.select("session_id", "ip", "bucket", "value", "anchor")


FIRST_SEEN = ["session_id", "user", "pattern"]


def stream_first_seen(entries: DataFrame, words: list[str] | None = None) -> DataFrame:
    """The first entry, by time and line, of each user and privilege pattern so far.

    A running minimum per key, merged on the map side: state is one small row per
    user and pattern, whatever arrives late or in which order. Write it in update
    mode; a key comes out again only when an earlier entry turns up, and
    :func:`first_seen` keeps the last word on each.
    """
    user = F.coalesce(non_empty(F.col("user_name")), F.lit("unknown"))
    matched = entries.select(
        "session_id", user.alias("user"), is_.privilege_pattern(F.col("raw_line"), words).alias("pattern"),
        F.struct("ts", "line_num", "raw_line").alias("entry"),
    ).filter(F.col("pattern").isNotNull())
    return matched.groupBy(*FIRST_SEEN).agg(F.min("entry").alias("first")).select(*FIRST_SEEN, "first.*")


def first_seen(written: DataFrame) -> DataFrame:
    """The first entries out of everything :func:`stream_first_seen` has written."""
    entry = F.struct("ts", "line_num", "raw_line")
    return written.groupBy(*FIRST_SEEN).agg(F.min(entry).alias("first")).select(*FIRST_SEEN, "first.*")


def stream_off_hours(entries: DataFrame) -> DataFrame:
    """Off-hours logins as findings. Keeps no state."""
    return rule_off_hours_access(entries)


def stream_to_tables(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True, mode: str = "append"
) -> StreamingQuery:
    """Write each micro-batch to its own folder.

    A batch that is repeated after a failure replaces its folder, so nothing is
    written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(df, write, checkpoint, available_now, mode)


def _started(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, mode: str) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    with state_store(df.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_to_job_tables(
    df: DataFrame, path: str, checkpoint: str, add: Callable[[DataFrame, str, str], None] = tables.add_entries,
    available_now: bool = True,
) -> StreamingQuery:
    """Commit each micro-batch to a table of the jobs, where ``read_entries`` and the rest find it.

    A batch is named by the query, whose id lies in its checkpoint, and its number. If
    it is repeated after a failure its name is committed already and nothing changes.
    ``add`` is :func:`tables.add_entries` or :func:`tables.add_findings`.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        query = spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id
        add(batch, path, f"s-{query}-{batch_id}")

    return _started(df, write, checkpoint, available_now, "append")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and read the result back.

    Windows the watermark has not passed stay open, as they must on a stream that
    goes on; :func:`replay` closes them.
    """
    stream_to_tables(df, path, checkpoint, mode=mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path).drop("batch")


END_OF_TIME = "2249-01-01 00:00:00"


def replay(
    entries: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, last: dict[str, str]
) -> DataFrame:
    """The whole result of ``build`` over a stream that has ended.

    When all its rows are through, one more row, at the end of time, is sent after
    them by a second source and moves the watermark past every open window, so
    the tail comes out like the rest. ``last`` has the fields of that row; it must
    pass the filters of ``build`` to be seen, and its own window never closes.
    """
    spark = entries.sparkSession
    closing = f"{path}-closing"
    blank = spark.range(1).select(*[
        F.lit(END_OF_TIME if f.name == "ts" else last.get(f.name)).cast(f.dataType).alias(f.name) for f in entries.schema.fields])
    blank.limit(0).write.parquet(closing)
    whole = build(entries.unionByName(spark.readStream.schema(entries.schema).parquet(closing)))
    run_to_end(whole, path, checkpoint)
    blank.write.mode("append").parquet(closing)
    run_to_end(whole, path, checkpoint)
    return spark.read.schema(whole.schema).parquet(path).drop("batch")
