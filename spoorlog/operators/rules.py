"""Threat rules: ``log_entries`` in, findings out.

A rule works on one file of a session at a time. What the rules look at (flags,
port, pattern, user) is drawn from an entry once, as a narrow row of facts. A window
rule merges facts per address and millisecond in that same scan, with the first few
line numbers of each, and writes the result; windows, samples and first lines all
come from this small table. A second scan of the entries looks up the text of the
sample lines, at most three a finding.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorlog import schemas
from spoorlog.functions import patterns as P
from spoorlog.functions import predicates as is_
from spoorlog.functions.dates import rfc1123
from spoorlog.functions.least import first_k
from spoorlog.functions.text import extract_destination_port, non_empty, stable_uuid
from spoorlog.operators.sliding import busy_rows, crowded, rows_in_window, sliding_window_max
from spoorlog.session import staged

MINUTE = 60_000
UNIT = ["session_id", "file_name"]
SOURCE = [*UNIT, "ip"]
#: What the built-in rules look at in an entry.
COLUMNS = [*SOURCE, "line_num", "ts", "user_name", "action", "status_code", "format", "raw_line"]
SAMPLE_LINES = 3
LISTED_PORTS = 10
UNITS = ((24 * 60 * MINUTE, "day"), (60 * MINUTE, "hour"), (MINUTE, "minute"), (1000, "second"), (1, "millisecond"))

Rule = Callable[[DataFrame], DataFrame]


def window_label(width: int) -> str:
    """``5 minutes``"""
    size, name = next((size, name) for size, name in UNITS if width % size == 0)
    n = width // size
    return f"{n} {name}" + "s" * (n != 1)


def window_word(width: int) -> str:
    """``5-minute``"""
    return "-".join(window_label(width).removesuffix("s").split(" "))


def _filled(template: str, **values: Column | str) -> Column:
    """A fixed text with its fields filled in."""
    parts = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        parts += [F.lit(text)] * bool(text)
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def _findings(
    df: DataFrame, rule_ord: int, kind: str, severity: str, title: Column, description: Column,
    seq: Column, evidence: Column,
) -> DataFrame:
    file = F.nullif(F.col("file_name"), F.lit(""))
    return schemas.conform(
        df.select(
            stable_uuid(F.col("session_id"), file, F.lit(kind), title, seq).alias("id"),
            "session_id",
            F.lit(kind).alias("type"),
            F.lit(severity).alias("severity"),
            title.alias("title"),
            description.alias("description"),
            F.lit("rule").alias("source"),
            F.current_timestamp().alias("created_at"),
            evidence.alias("evidence"),
            F.lit(rule_ord).alias("rule_ord"),
            seq.cast("bigint").alias("seq"),
            file.alias("file_name"),
        ),
        schemas.FINDINGS,
    )


def _user() -> Column:
    return F.coalesce(non_empty(F.col("user_name")), F.lit("unknown"))


def facts(entries: DataFrame, port: Column | None = None, words: list[str] | None = None) -> DataFrame:
    """Narrow rows of the entries that any rule may use.

    Only lines of privileged commands and off-hours logins, few in any log, keep
    their text.
    """
    port = extract_destination_port(F.col("raw_line")) if port is None else port
    pattern = is_.privilege_pattern(F.col("raw_line"), words)
    login = F.col("ts").isNotNull() & is_.is_login_success() & is_.is_off_hours(F.col("ts"))
    absent = {c: F.lit(None).cast("string") for c in ("user_name", "action", "format", "status_code") if c not in entries.columns}
    rows = schemas.with_file(entries).withColumns(absent).select(
        *SOURCE, "line_num", "ts", F.unix_millis("ts").alias("ms"),
        F.coalesce(is_.is_ssh_failure(), F.lit(False)).alias("ssh"),
        F.coalesce(is_.is_http_auth_failure(), F.lit(False)).alias("web"),
        F.when(is_.has_ip(), port).alias("port"), _user().alias("user"), pattern.alias("pattern"),
        F.coalesce(login, F.lit(False)).alias("login"), "raw_line",
    )
    used = F.col("ssh") | F.col("web") | F.col("port").isNotNull() | F.col("pattern").isNotNull() | F.col("login")
    text = F.when(F.col("pattern").isNotNull() | F.col("login"), F.col("raw_line"))
    return rows.filter(used).withColumn("raw_line", text)


def instants(rows: DataFrame, distinct: str | None = None) -> DataFrame:
    """Matching lines merged per address and millisecond, and per ``distinct`` value: how many, the first, the first few."""
    line = F.col("line_num").cast("bigint")
    return rows.groupBy(*SOURCE, "ms", *([distinct] if distinct else [])).agg(
        F.count(F.lit(1)).alias("n"), F.min(line).alias("seq"), first_k(line, SAMPLE_LINES).alias("lines"))


def _window_hits(rows: DataFrame, width: int, threshold: int, distinct: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per address above the limit: value, first matching line and the sample lines; and the instants inside its window.

    ``rows`` is read once, into a written table of instants; all that follows reads
    that. No time and the epoch itself never anchor a window.
    """
    merged = staged(instants(rows, distinct), "rule-instants")
    firsts = merged.groupBy(*SOURCE).agg(F.min("seq").alias("seq"))
    timed = merged.filter(F.col("ms").isNotNull() & (F.col("ms") != 0))
    busy = busy_rows(timed, SOURCE, width, threshold, "n")
    pieces = crowded(timed, SOURCE, width)
    anchors = staged(sliding_window_max(busy, SOURCE, width, threshold, distinct, "n", pieces), "rule-anchors")
    inside = rows_in_window(timed, anchors, SOURCE, width)
    each = inside.select(*SOURCE, "value", "ms", F.explode("lines").alias("line_num"))
    samples = each.groupBy(*SOURCE, "value").agg(first_k(F.struct("ms", "line_num"), SAMPLE_LINES)["line_num"].alias("lines"))
    return samples.join(firsts, SOURCE), inside


def _hits(found: DataFrame, rule_ord: int, title: str, text: str, width: int, ports: Column | None = None) -> DataFrame:
    """What the window rules have in common, before the sample lines have their text."""
    ip, n = F.col("ip"), F.col("value")
    return found.select(
        *SOURCE, F.lit(rule_ord).alias("rule_ord"), "value", "seq", "lines",
        (F.lit(None).cast("array<bigint>") if ports is None else ports.cast("array<bigint>")).alias("ports"),
        _filled(title, ip=ip).alias("title"), _filled(text, ip=ip, n=n, window=window_word(width)).alias("description"),
        F.lit(window_label(width)).alias("label"))


def _ssh_hits(known: DataFrame, window_ms: int = 5 * MINUTE, threshold: int = 10) -> DataFrame:
    found, _ = _window_hits(known.filter("ssh"), window_ms, threshold)
    return _hits(found, 1, P.SSH_TITLE, P.SSH_TEXT, window_ms)


def _web_hits(known: DataFrame, window_ms: int = 5 * MINUTE, threshold: int = 20) -> DataFrame:
    found, _ = _window_hits(known.filter("web"), window_ms, threshold)
    return _hits(found, 2, P.WEB_TITLE, P.WEB_TEXT, window_ms)


def _scan_hits(known: DataFrame, window_ms: int = MINUTE, threshold: int = 20) -> DataFrame:
    found, inside = _window_hits(known.filter(F.col("port").isNotNull()), window_ms, threshold, "port")
    firsts = inside.groupBy(*SOURCE, "port").agg(F.min(F.struct("ms", "seq")).alias("first"))
    listed = firsts.groupBy(*SOURCE).agg(first_k(F.struct("first", "port"), LISTED_PORTS)["port"].alias("ports"))
    return _hits(found.join(listed, SOURCE), 3, P.SCAN_TITLE, P.SCAN_TEXT, window_ms, F.col("ports"))


KINDS = {1: ("brute_force_ssh", "high"), 2: ("brute_force_web", "medium"), 3: ("port_scan", "high")}


def _with_texts(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of the window rules as findings: one join looks up the sample lines of all of them."""
    hits = staged(hits, "rule-hits")
    key = [*UNIT, "rule_ord", "title"]
    wanted = hits.select(*key, F.posexplode("lines").alias("rank", "line_num"))
    texts = schemas.with_file(entries).select(*UNIT, "line_num", "raw_line")
    found = texts.join(wanted, [*UNIT, "line_num"]).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "raw_line")))["raw_line"].alias("texts"))
    both = hits.join(found, key)
    count = lambda *ords: F.when(F.col("rule_ord").isin(*ords), F.col("value"))
    evidence = schemas.evidence(
        ip=F.col("ip"), count=count(1, 2), distinctPortsCount=count(3), ports=F.col("ports"),
        timeWindow=F.col("label"), sampleLines=F.col("texts"))
    of = lambda i: reduce(lambda rest, k: F.when(F.col("rule_ord") == k, KINDS[k][i]).otherwise(rest), KINDS, F.lit(None))
    file = F.nullif(F.col("file_name"), F.lit(""))
    return schemas.conform(
        both.select(
            stable_uuid(F.col("session_id"), file, of(0), F.col("title"), F.col("seq")).alias("id"), "session_id",
            of(0).alias("type"), of(1).alias("severity"), "title", "description", F.lit("rule").alias("source"),
            F.current_timestamp().alias("created_at"), evidence.alias("evidence"), "rule_ord", "seq", file.alias("file_name")),
        schemas.FINDINGS)


def rule_brute_force_ssh(
    entries: DataFrame, window_ms: int = 5 * MINUTE, threshold: int = 10
) -> DataFrame:
    """More than ``threshold`` failed SSH logins of one address in a window."""
    return _with_texts(entries, _ssh_hits(facts(entries), window_ms, threshold))


def rule_brute_force_web(
    entries: DataFrame, window_ms: int = 5 * MINUTE, threshold: int = 20
) -> DataFrame:
    """The same on HTTP 401 and 403 responses."""
    return _with_texts(entries, _web_hits(facts(entries), window_ms, threshold))


def rule_port_scan(
    entries: DataFrame, window_ms: int = MINUTE, threshold: int = 20,
    port: Column | None = None,
) -> DataFrame:
    """More than ``threshold`` distinct destination ports of one address."""
    return _with_texts(entries, _scan_hits(facts(entries, port), window_ms, threshold))


def _privilege_findings(known: DataFrame) -> DataFrame:
    found = known.filter(F.col("pattern").isNotNull()).groupBy(*UNIT, "user", "pattern").agg(
        F.min(F.struct("line_num", "raw_line")).alias("first")
    )
    user, pattern, line = F.col("user"), F.col("pattern"), F.col("first.line_num")
    return _findings(
        found, 4, "privilege_escalation", "medium",
        _filled(P.PRIVILEGE_TITLE, user=user, pattern=pattern), _filled(P.PRIVILEGE_TEXT, user=user, pattern=pattern), line,
        schemas.evidence(
            userName=user, triggeredPattern=pattern, rawLine=F.col("first.raw_line"), lineNum=line
        ),
    )


def _login_findings(known: DataFrame) -> DataFrame:
    user = F.col("user")
    return _findings(
        known.filter("login"), 5, "off_hours_access", "low",
        _filled(P.LOGIN_TITLE, user=user), _filled(P.LOGIN_TEXT, user=user), F.col("line_num"),
        schemas.evidence(
            userName=user, timestampUTC=rfc1123(F.col("ts")), rawLine=F.col("raw_line")
        ),
    )


def rule_privilege_escalation(entries: DataFrame, words: list[str] | None = None) -> DataFrame:
    """The first line of each user and privilege pattern."""
    return _privilege_findings(facts(entries, words=words))


def rule_off_hours_access(entries: DataFrame) -> DataFrame:
    """Every successful login between 23:00 and 05:00 UTC."""
    return _login_findings(facts(entries))


#: How the built-in rules work on facts: window rules give hits, the others findings.
_HITS = {rule_brute_force_ssh: _ssh_hits, rule_brute_force_web: _web_hits, rule_port_scan: _scan_hits}
_DIRECT = {rule_privilege_escalation: _privilege_findings, rule_off_hours_access: _login_findings}

BUILT_IN: dict[str, Rule] = {
    "brute_force_ssh": rule_brute_force_ssh,
    "brute_force_web": rule_brute_force_web,
    "port_scan": rule_port_scan,
    "privilege_escalation": rule_privilege_escalation,
    "off_hours_access": rule_off_hours_access,
}
_registered: dict[str, Rule] = {}


def register_rule(name: str, rule: Rule) -> None:
    """Add a rule of your own: entries to a DataFrame in the findings schema."""
    _registered[name] = rule


def unregister_rule(name: str) -> None:
    _registered.pop(name, None)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_rules(entries: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """All findings, in the order of ``rule_ord`` and ``seq`` within a session.

    Pass a written table, as the ingest job does. The built-in rules, also as
    partials with other limits, share one table of facts, written here from one
    scan of the lines, and one lookup of their sample lines, a second scan. Rules
    of your own read ``entries`` themselves. No rules give no findings.
    """
    chosen = {**BUILT_IN, **_registered} if rules is None else rules
    calls = [(getattr(r, "func", r), getattr(r, "args", ()), getattr(r, "keywords", {}), r) for r in chosen.values()]
    shared = [c for c in calls if not {"port", "words"} & set(c[2]) and (c[0] in _HITS or c[0] in _DIRECT)]
    parts = [c[3](entries) for c in calls if c not in shared]
    if shared:
        known = staged(facts(entries), "rule-facts")
        hits = [_HITS[f](known, *args, **more) for f, args, more, _ in shared if f in _HITS]
        parts += [_DIRECT[f](known) for f, _, _, _ in shared if f in _DIRECT]
        if hits:
            parts.append(_with_texts(entries, _union(hits)))
    return _union(parts) if parts else entries.sparkSession.createDataFrame([], schemas.FINDINGS)
