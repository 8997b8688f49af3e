"""From raw files to entries, findings and embedded chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spoorlog.operators.chunking import chunk_lines, embed_hashed
from spoorlog.operators.formats import FORMATS, format_of_heads, sniff_by_name
from spoorlog.operators.parsers import parse_logs, validate_entries
from spoorlog.operators.rules import run_rules
from spoorlog.session import prepare, staged
from spoorlog.sources import tables
from spoorlog.sources.logs import read_surveyed

PROGRESS = "format string, parsed bigint, failed bigint, embedded bigint"


def ingest(
    spark: SparkSession, source: str | list[str], target: str, default_year: int,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed, owner: str | DataFrame | None = None,
) -> DataFrame:
    """Parse everything under ``source`` into tables under ``target``.

    The raw text is read twice: a survey counts the lines of every split and keeps
    the first few, from which formats and session labels come; the parse is the
    second pass. Entries are written first, and rules and chunker read back that
    batch. A rerun replaces the sessions it covers in every table, also where they
    have no rows any more. Files of one session are parsed, checked and cut apart.

    Sessions are written as ``processing`` before the parse and ``completed`` at the
    end; if a step fails they become ``failed`` and the error goes on. A job that is
    killed leaves them processing. They belong to ``owner``, a user's id or a table
    of session_id and user_id.

    Returns per format the lines parsed and failed, and the chunks that the whole
    job embedded, counted while they were written.
    """
    lines, files = read_surveyed(prepare(spark), source)
    formats = staged(format_of_heads(files).select("session_id", "file_name", "format"), "formats")
    covered = formats.select("session_id").distinct()
    log = f"{target}/sessions"
    opened = staged(session_rows(files, owner), "sessions")
    tables.write_sessions(opened.withColumn("status", F.lit("processing")), log)
    try:
        seen, embedded = Observation("entries"), Observation("chunks")
        failed = F.col("parse_error").isNotNull()
        entries = validate_entries(parse_logs(lines, default_year, formats)).observe(seen, *[
            F.count_if((F.col("format") == f) & (failed == lost)).alias(f"{f}_{int(lost)}") for f in FORMATS for lost in (False, True)])
        batch = tables.write_entries(entries, f"{target}/entries", covered)
        stored = tables.read_entries(spark, f"{target}/entries", batch=batch)
        tables.write_findings(run_rules(stored), f"{target}/findings", covered)
        chunks = embed(chunk_lines(stored)).withColumn("created_at", F.current_timestamp())
        chunks = chunks.observe(embedded, F.count("embedding").alias("n"))
        tables.write_chunks(chunks, f"{target}/chunks", covered=covered)
        counts = stored.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"))
        done = opened.join(counts, opened["id"] == counts["session_id"], "left").withColumns({
            "log_count": F.coalesce("entries", F.lit(0)), "status": F.lit("completed"), "updated_at": F.current_timestamp()})
        tables.write_sessions(done.drop("session_id", "entries"), log)
    except BaseException:
        tables.write_sessions(opened.withColumns({"status": F.lit("failed"), "updated_at": F.current_timestamp()}), log)
        raise
    got = seen.get
    rows = [(f, got[f"{f}_0"], got[f"{f}_1"], embedded.get["n"]) for f in FORMATS if got[f"{f}_0"] or got[f"{f}_1"]]
    return spark.createDataFrame(rows, PROGRESS)


def session_rows(files: DataFrame, owner: str | DataFrame | None = None) -> DataFrame:
    """A ``sessions`` row per session of surveyed files, with its source label by name and first line.

    The label comes from the first file by upload time, then path. Count and status are left to the job.
    """
    first = F.struct(F.coalesce("upload_ts", F.timestamp_millis(F.lit(0))).alias("at"), "file_name")
    heads = files.groupBy("session_id").agg(
        F.min_by(F.struct("upload_name", "first_line"), first).alias("head"), F.min("upload_ts").alias("created_at"))
    if isinstance(owner, DataFrame):
        heads = heads.join(owner.groupBy("session_id").agg(F.min("user_id").alias("user_id")), "session_id", "left")
    else:
        heads = heads.withColumn("user_id", F.lit(owner).cast("string"))
    label = sniff_by_name(F.col("head.upload_name"), F.col("head.first_line"))
    return heads.select(
        F.col("session_id").alias("id"), "user_id", F.col("head.upload_name").alias("name"), label.alias("log_source"),
        F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("log_count"),
        F.coalesce("created_at", F.current_timestamp()).alias("created_at"), F.current_timestamp().alias("updated_at"))
