"""Report and dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.functions import patterns as P
from spoorlog.functions.predicates import finding_matches
from spoorlog.functions.text import non_empty


def _count() -> Column:
    return F.count(F.lit(1))


def severity_matrix(findings: DataFrame) -> DataFrame:
    """One row per session with a count per severity."""
    counts = [
        F.count_if(F.col("severity") == name).alias(f"{name}_count") for name in P.SEVERITIES
    ]
    return findings.groupBy("session_id").agg(*counts)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Chart form: one row per session and severity that occurs."""
    known = findings.filter(F.col("severity").isin(P.SEVERITIES))
    return known.groupBy("session_id", "severity").agg(_count().alias("count"))


def total_events(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """Stored entries, else the session's own count, else 0."""
    stored = entries.groupBy("session_id").agg(_count().alias("stored"))
    kept = F.coalesce("stored", F.nullif(F.col("log_count"), F.lit(0)), F.lit(0))
    return (
        sessions.select(F.col("id").alias("session_id"), "log_count")
        .join(stored, "session_id", "left")
        .select("session_id", kept.cast("bigint").alias("total_events"))
    )


def hourly_histogram(entries: DataFrame) -> DataFrame:
    """Entries per UTC hour of the day, all dates together."""
    timed = entries.filter(F.col("ts").isNotNull())
    hour = F.concat(F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit(":00"))
    return timed.groupBy("session_id", hour.alias("hour")).agg(_count().alias("count"))


def top_sources(findings: DataFrame, entries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` addresses or accounts with most findings in each session.

    Sessions whose findings name none use the addresses of their entries. Equal
    counts keep the order of first appearance.
    """
    named = F.coalesce(
        non_empty(F.col("evidence.ip")), non_empty(F.col("evidence.userName"))
    ).alias("source")
    place = F.struct(F.col("rule_ord"), F.col("seq"))
    found = (
        findings.select("session_id", named, place.alias("place"))
        .filter(F.col("source").isNotNull())
        .groupBy("session_id", "source")
        .agg(_count().alias("count"), F.min("place").alias("first"))
    )
    place = F.struct(F.lit(0).alias("rule_ord"), F.col("line_num").cast("bigint").alias("seq"))
    seen = (
        entries.select("session_id", non_empty(F.col("ip")).alias("source"), place.alias("place"))
        .filter(F.col("source").isNotNull())
        .groupBy("session_id", "source")
        .agg(_count().alias("count"), F.min("place").alias("first"))
        .join(found.select("session_id").distinct(), "session_id", "left_anti")
    )
    order = Window.partitionBy("session_id").orderBy(F.desc("count"), "first", "source")
    label = (
        F.when(F.col("rank") == 1, "Primary Target")
        .when(F.col("rank") <= 3, "Suspicious Vector")
        .otherwise("Moderate Interaction")
    )
    return (
        found.unionByName(seen)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("session_id", "source", "count", "rank", label.alias("risk"))
    )


def ioc_summary(findings: DataFrame, include_scan_ports: bool = False) -> DataFrame:
    """Distinct addresses and ports named in a session's findings.

    One row per indicator rather than one array per session, since nothing
    bounds how many a session has. Ports of scans count on request only.
    """
    ev = lambda name: F.col(f"evidence.{name}")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ips = F.concat(
        F.when(non_empty(ev("ip")).isNotNull(), F.array(ev("ip"))).otherwise(none("string")),
        F.coalesce(ev("affectedIps"), none("string")),
        F.coalesce(ev("iocs.ips"), none("string")),
    )
    ports = F.coalesce(ev("iocs.ports"), none("bigint"))
    if include_scan_ports:
        ports = F.concat(ports, F.coalesce(ev("ports"), none("bigint")))
    tag = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("value"))
    both = F.concat(F.transform(ips, tag("ip")), F.transform(ports, tag("port")))
    return findings.select("session_id", F.inline(both)).distinct()


def incident_timeline(entries: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` timed entries of each session."""
    order = Window.partitionBy("session_id").orderBy("ts", "line_num")
    shown = lambda name: F.coalesce(non_empty(F.col(name)), F.lit("-")).alias(name)
    return (
        entries.filter(F.col("ts").isNotNull())
        .select("session_id", "ts", "line_num", "ip", "action", "resource")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            "session_id", "rank", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            shown("ip"), shown("action"), shown("resource"),
        )
    )


def session_summary(
    sessions: DataFrame, entries: DataFrame, findings: DataFrame, qa: DataFrame
) -> DataFrame:
    """Status and the counts of entries, findings and answers per session.

    Each table is counted before it is joined, so the joins are of one row per
    session.
    """
    out = sessions.select(F.col("id").alias("session_id"), "name", "status", "log_count")
    for table, name in ((entries, "entries"), (findings, "findings"), (qa, "answers")):
        counts = table.groupBy("session_id").agg(_count().alias(name))
        out = out.join(counts, "session_id", "left")
    return out.fillna(0, ["entries", "findings", "answers"])


def session_dashboard(
    sessions: DataFrame, entries: DataFrame, findings: DataFrame, qa: DataFrame
) -> DataFrame:
    """:func:`session_summary` with total events and the severity counts."""
    severities = severity_matrix(findings)
    total = F.coalesce(
        F.nullif(F.col("entries"), F.lit(0)), F.nullif(F.col("log_count"), F.lit(0)), F.lit(0)
    )
    counts = [f"{name}_count" for name in P.SEVERITIES]
    return (
        session_summary(sessions, entries, findings, qa)
        .join(severities, "session_id", "left")
        .fillna(0, counts)
        .withColumn("total_events", total.cast("bigint"))
    )


def parse_quality(entries: DataFrame) -> DataFrame:
    """Parsed and failed lines per session and format."""
    failed = F.col("parse_error").isNotNull()
    return entries.groupBy("session_id", "format").agg(
        F.count_if(~failed).alias("parsed"), F.count_if(failed).alias("failed")
    )


def filter_findings(findings: DataFrame, severity: str = "all", text: str = "") -> DataFrame:
    return findings.filter(finding_matches(severity, text))


def findings_table(findings: DataFrame) -> DataFrame:
    """Severity, title, affected address and recommendation of each finding."""
    first = lambda name: non_empty(F.get(F.col(f"evidence.{name}"), F.lit(0)))
    return findings.select(
        "session_id", "rule_ord", "seq", "type",
        F.upper("severity").alias("severity"),
        "title",
        F.coalesce(
            non_empty(F.col("evidence.ip")), first("affectedIps"), F.lit(P.UNKNOWN_ASSET)
        ).alias("affected"),
        F.coalesce(first("recommendations"), F.lit(P.DEFAULT_RECOMMENDATION)).alias("recommendation"),
    )


def finding_evidence_lines(findings: DataFrame) -> DataFrame:
    """Evidence as shown: the sample lines, else the raw line, else the JSON."""
    raw = non_empty(F.col("evidence.rawLine"))
    lines = F.coalesce(
        F.col("evidence.sampleLines"),
        F.when(raw.isNotNull(), F.array(raw)),
        F.array(F.to_json("evidence")),
    )
    return (
        findings.filter(F.col("evidence").isNotNull())
        .select("session_id", "rule_ord", "seq", "title", F.posexplode(lines).alias("line_pos", "line"))
        .withColumn("line_pos", F.col("line_pos") + 1)
    )
