"""The tables of an incident report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spoorlog import schemas
from spoorlog.operators import reports
from spoorlog.sources import tables


def report(
    entries: DataFrame, findings: DataFrame, sessions: DataFrame | None = None, qa: DataFrame | None = None,
    target_asset: str = "", analysis_date: str = "",
) -> dict[str, DataFrame]:
    """Every table of the report and of the overview, for all sessions at once.

    With a sessions table also the dashboard and the total of events.
    """
    more = {}
    if sessions is not None:
        none = entries.sparkSession.createDataFrame([], schemas.QA_HISTORY)
        more = {
            "dashboard": reports.session_dashboard(sessions, entries, findings, none if qa is None else qa),
            "events": reports.total_events(sessions, entries),
        }
    return {
        **more,
        "quality": reports.parse_quality(entries),
        "evidence": reports.finding_evidence_lines(findings),
        "briefing": tables.incident_report(findings, target_asset, analysis_date),
        "briefing_lines": tables.report_lines(findings),
        "timeline": reports.incident_timeline(entries),
        "indicators": reports.ioc_summary(findings),
        "findings": reports.findings_table(findings),
        "severities": reports.severity_matrix(findings),
        "hours": reports.hourly_histogram(entries),
        "sources": reports.top_sources(findings, entries),
    }
