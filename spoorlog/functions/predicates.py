"""Boolean expressions over ``log_entries`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorlog.functions import patterns as P
from spoorlog.functions.text import first_word, has_any, non_empty


def _action() -> Column:
    return F.coalesce(F.col("action"), F.lit(""))


def has_ip() -> Column:
    return non_empty(F.col("ip")).isNotNull()


def is_ssh_failure() -> Column:
    raw, lower = F.col("raw_line"), F.lower("raw_line")
    ssh = (F.col("format") == "syslog") | F.contains(raw, F.lit("secure")) | F.contains(lower, F.lit("ssh"))
    failed = _action().isin("sshd_failed", "auth_failure") | has_any(lower, P.SSH_FAILURE_WORDS)
    return ssh & failed & has_ip()


def is_http_auth_failure() -> Column:
    return F.coalesce(F.col("status_code"), F.lit(0)).isin(401, 403) & has_ip()


def is_login_success() -> Column:
    ok = F.col("status_code").isNull() | (F.col("status_code") == 200)
    return ((_action() == "login") & ok) | has_any(F.lower("raw_line"), P.LOGIN_WORDS)


def is_off_hours(ts: Column) -> Column:
    """23:00 to 04:59 UTC."""
    return (F.hour(ts) >= 23) | (F.hour(ts) < 5)


def privilege_pattern(raw: Column, words: list[str] | None = None) -> Column:
    return first_word(F.lower(raw), words or P.PRIVILEGE_WORDS)


def finding_matches(severity: str = "all", text: str = "") -> Column:
    """Severity filter plus case-insensitive search in title, type and text."""
    wanted = F.lit(text.lower())
    found = F.lit(False)
    for name in ("title", "type", "description"):
        found = found | F.coalesce(F.contains(F.lower(name), wanted), F.lit(False))
    return found if severity == "all" else found & (F.col("severity") == severity)
