"""Raw log files as a table of numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoorlog.functions.least import first_k
from spoorlog.functions.text import is_blank
from spoorlog.session import prepare, staged

SUFFIXES = ("log", "txt", "json", "csv")
UPLOAD_NAME = r"^([^_]+)_(\d{13})_(.+)$"


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in suffix)


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line of every log file under ``path``.

    Large files are cut into splits that are read in parallel. Only a line feed
    ends a line, and one carriage return before it is dropped. Suffixes count in
    either case; :func:`other_files` tells what is passed over.
    """
    lines = (
        prepare(spark).read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(map(_any_case, SUFFIXES)) + "}")
        .text(path)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.regexp_replace("value", r"\r\z", "").alias("raw_line"),
    )


def other_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` that are no logs by their suffix: path and length. Contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.col("path").alias("file_path"), "length"))
    return files.filter(~F.lower("file_path").rlike(r"\.(" + "|".join(SUFFIXES) + r")\z"))


def session_from_path(df: DataFrame) -> DataFrame:
    """Session, upload time and original name out of an upload's file name.

    Files not named that way are their own session, under their full path.
    """
    part = lambda group: F.nullif(F.regexp_extract("file_name", UPLOAD_NAME, group), F.lit(""))
    return df.withColumns(
        {
            "session_id": F.coalesce(part(1), F.col("file_path")),
            "upload_ts": F.timestamp_millis(part(2).cast("bigint")),
            "upload_name": F.coalesce(part(3), F.col("file_name")),
        }
    )


HEAD_LINES = 5
SPLIT = ["file_path", "block_start"]


def survey(lines: DataFrame) -> DataFrame:
    """One row per file split, from a single pass over the raw lines; written and read back.

    Its number of lines, its first row id, its offset in the file, its first line and
    its first five non-blank lines. Rows reach a task in order and the lines kept are
    few, so nothing is sorted; only these rows are shuffled.
    """
    row, text = F.col("row_id"), F.col("raw_line")
    splits = lines.groupBy(*SPLIT, "file_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.min(F.struct(row, text))["raw_line"].alias("first_line"),
        first_k(F.struct(is_blank(text).alias("blank"), row, text), HEAD_LINES).alias("heads"))
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return staged(splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "splits")


def with_line_numbers(lines: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """1-based physical line number within each file, blank lines included.

    A line's place inside its split follows from the row ids Spark hands out
    per task. A first pass, :func:`survey`, counts the lines of each split; a running
    total over the splits of a file gives each split's offset. Only that small table
    is moved, and the lines themselves are never shuffled or sorted for it.

    Both passes must cut the files alike, which :func:`prepare` pins. A line that
    does not fall into the split counted for it stops the job, rather than get a
    wrong number.
    """
    offsets = (survey(lines) if splits is None else splits).select(*SPLIT, "n", "first_row", "offset")
    place = F.col("row_id") - F.col("first_row")
    number = F.when(
        (place >= 0) & (place < F.col("n")), F.col("offset") + place + 1
    ).otherwise(F.raise_error(F.lit("the files were split differently in the two passes")).cast("bigint"))
    return (
        lines.join(offsets, SPLIT, "left")
        .withColumn("line_num", number)
        .drop("offset", "first_row", "n", "row_id", "block_start")
    )


def _named(df: DataFrame) -> DataFrame:
    """Session and upload of each row; ``file_name`` becomes the whole path, so that
    two uploads of one session stay apart whatever they are called."""
    return session_from_path(df).withColumn("file_name", F.col("file_path"))


def read_sessions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Numbered lines with their session, ready for the parsers."""
    return _named(with_line_numbers(read_logs(spark, path)))


def read_surveyed(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The lines of :func:`read_sessions`, and what the counting pass saw of each file.

    The second has a row per file: session_id, file_name, upload_name, upload_ts,
    first_line, and ``heads``, its first five non-blank lines (blank ones if it has
    fewer) as line_num and raw_line. It costs no further pass over the raw text.
    """
    raw = read_logs(spark, path)
    splits = survey(raw)
    of_file = splits.groupBy("file_path", "file_name").agg(
        F.min_by("first_line", "block_start").alias("first_line"),
        F.flatten(F.collect_list(F.transform("heads", lambda h: F.struct(
            h["blank"].alias("blank"), (F.col("offset") + h["row_id"] - F.col("first_row") + 1).alias("line_num"), h["raw_line"].alias("raw_line"))))).alias("all"))
    heads = F.transform(F.slice(F.array_sort("all"), 1, HEAD_LINES), lambda h: F.struct(h["line_num"].alias("line_num"), h["raw_line"].alias("raw_line")))
    files = _named(of_file).select("session_id", "file_name", "upload_name", "upload_ts", "first_line", heads.alias("heads"))
    return _named(with_line_numbers(raw, splits)), staged(files, "files")


def non_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_blank(F.col("raw_line")))
