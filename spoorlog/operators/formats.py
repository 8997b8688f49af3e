"""Which format a file is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorlog.functions import patterns as P
from spoorlog.functions.least import first_k
from spoorlog.functions.text import is_blank, trim

FORMATS = ["cloudtrail", "apache", "syslog", "generic"]  # order settles equal scores
HEAD_LINES = 5


def without_trailing_comma(trimmed: Column) -> Column:
    cut = trim(F.substring(trimmed, F.lit(1), F.length(trimmed) - 1))
    return F.when(F.endswith(trimmed, F.lit(",")), cut).otherwise(trimmed)


def present(variant: Column, path: str) -> Column:
    """Text of a JSON field; NULL where absent, empty, zero, false or null."""
    text = F.try_variant_get(variant, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    falsy = (text == "") | ((kind != "STRING") & text.isin("0", "false"))
    return F.when(~falsy, text)


def score_lines(lines: DataFrame) -> DataFrame:
    """Adds one score column per format to lines."""
    trimmed = lines.withColumn("trimmed", trim(F.col("raw_line")))
    parsed = trimmed.withColumns(
        {
            "json": F.try_parse_json(without_trailing_comma(F.col("trimmed"))),
            "pairs": F.size(F.regexp_extract_all("trimmed", F.lit(P.java(P.KEY_VALUE)), 0)),
        }
    )
    kind = F.schema_of_variant("json")
    audit = F.coalesce(
        *[
            present(F.col("json"), f"$.{name}")
            for name in ("eventTime", "eventVersion", "userIdentity", "eventName", "eventSource")
        ]
    )
    matches = lambda pattern: F.col("trimmed").rlike(P.java(pattern))
    return parsed.withColumns(
        {
            "cloudtrail": F.when(kind.startswith("OBJECT") & audit.isNotNull(), 5)
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), 2)
            .otherwise(0),
            "apache": F.when(matches(P.ACCESS), 5).otherwise(0),
            "syslog": F.when(matches(P.RFC5424_SNIFF) | matches(P.BSD), 5).otherwise(0),
            "generic": F.when(F.col("pairs") >= 2, F.col("pairs")).otherwise(0),
        }
    ).drop("trimmed", "json", "pairs")


def file_keys(lines: DataFrame) -> list[str]:
    """What names a file: its session, and the file if the lines say so."""
    return ["session_id", "file_name"] if "file_name" in lines.columns else ["session_id"]


def detect_format(lines: DataFrame) -> DataFrame:
    """One row per file: its format and the scores behind it.

    The first five non-blank lines vote. They are picked by an aggregate that keeps
    five lines per file in each task and sorts nothing, so only those are moved and
    scored. Blank lines come last, so a file of blank lines only still gets its row.
    """
    keys = file_keys(lines)
    place = F.struct(is_blank(F.col("raw_line")).alias("blank"), "line_num", "raw_line")
    heads = lines.groupBy(*keys).agg(first_k(place, HEAD_LINES).alias("heads"))
    return format_of_heads(heads)


def format_of_heads(heads: DataFrame) -> DataFrame:
    """The same from the first lines of each file, an array ``heads`` with ``raw_line``."""
    keys = [k for k in ("session_id", "file_name") if k in heads.columns]
    scores = (
        score_lines(heads.select(*keys, F.explode("heads.raw_line").alias("raw_line")))
        .groupBy(*keys)
        .agg(*[F.sum(name).cast("bigint").alias(f"{name}_score") for name in FORMATS])
    )
    best = F.greatest(*[F.col(f"{name}_score") for name in FORMATS])
    chosen = F.when(best == 0, "generic")
    for name in FORMATS:
        chosen = chosen.when(F.col(f"{name}_score") == best, name)
    return scores.withColumn("format", chosen)


def sniff_by_name(file_name: Column, first_line: Column) -> Column:
    """Quick guess from a file's name and first line, used as the source label."""
    has = lambda *words: [F.contains(first_line, F.lit(w)) for w in words]
    json_like = F.endswith(F.lower(file_name), F.lit(".json")) | F.startswith(first_line, F.lit("{"))
    syslog, daemon = has("syslog", "sshd[")
    get, post, http = has("GET ", "POST ", "HTTP/1.")
    return (
        F.when(json_like | has('"Events":')[0], "cloudtrail")
        .when(first_line.rlike(r"^<\d+>") | syslog | daemon, "syslog")
        .when(get | post | http, "apache")
        .otherwise("generic")
    )
