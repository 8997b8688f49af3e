"""Row types shared by the jobs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_LINES = "session_id string, file_name string, line_num bigint, raw_line string"

LOG_ENTRIES = (
    "id string, session_id string, line_num bigint, ts timestamp, ip string, user_name string, "
    "action string, resource string, status_code int, raw_line string, format string, "
    "parse_error string, file_name string"
)

SESSIONS = (
    "id string, user_id string, name string, log_source string, status string, "
    "log_count bigint, created_at timestamp, updated_at timestamp"
)

CHUNKS = (
    "id string, session_id string, chunk_text string, embedding array<float>, "
    "chunk_index bigint, line_start bigint, line_end bigint, created_at timestamp, file_name string"
)

# Superset of what the rules and analysts record; absent fields are NULL.
EVIDENCE_FIELDS = {
    "ip": "string",
    "count": "bigint",
    "distinctPortsCount": "bigint",
    "ports": "array<bigint>",
    "timeWindow": "string",
    "sampleLines": "array<string>",
    "userName": "string",
    "triggeredPattern": "string",
    "rawLine": "string",
    "lineNum": "bigint",
    "timestampUTC": "string",
    "affectedIps": "array<string>",
    "recommendations": "array<string>",
    "iocs": "struct<ips: array<string>, ports: array<bigint>>",
}
EVIDENCE = "struct<" + ", ".join(f"{n}: {t}" for n, t in EVIDENCE_FIELDS.items()) + ">"

FINDINGS = (
    "id string, session_id string, type string, severity string, title string, "
    f"description string, source string, created_at timestamp, evidence {EVIDENCE}, "
    "rule_ord int, seq bigint, file_name string"
)

ANSWER = (
    "struct<summary: string, severity: string, threatCategories: array<string>, "
    "findings: array<struct<title: string, severity: string, affectedIps: array<string>, "
    "affectedUsers: array<string>, evidence: array<string>, iocs: struct<ips: array<string>, "
    "ports: array<double>, userAgents: array<string>, hashes: array<string>>>>, "
    "recommendations: array<string>>"
)

QA_HISTORY = f"id string, session_id string, question string, answer {ANSWER}, created_at timestamp"

USERS = "id string, name string, email string, image string, created_at timestamp"


def evidence(**fields: Column) -> Column:
    """Evidence struct with the given fields set."""
    unknown = set(fields) - set(EVIDENCE_FIELDS)
    if unknown:
        raise ValueError(f"unknown evidence fields: {sorted(unknown)}")
    return F.struct(
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in EVIDENCE_FIELDS.items()
        ]
    )


@lru_cache(maxsize=None)
def _fields(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields


def with_file(df: DataFrame) -> DataFrame:
    """Rows that belong to a file of their session; without one, the session is one file."""
    name = F.coalesce("file_name", F.lit("")) if "file_name" in df.columns else F.lit("")
    return df.withColumn("file_name", name)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select the columns of ``schema`` with their types; missing ones are NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in _fields(schema)
        ]
    )
