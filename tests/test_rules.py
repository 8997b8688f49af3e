import datetime as dt
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from spoorlog import schemas
from spoorlog.operators import rules
from spoorlog.operators.parsers import parse_logs
from tests import loops

T0 = dt.datetime(2025, 9, 3, 8)
ADDRESS = "172.20.3.4"


@pytest.fixture
def entries(spark):
    def make(rows):
        """Rows of (offset seconds or None or datetime, changed fields)."""
        out = []
        for i, (at, change) in enumerate(rows):
            row = dict(
                id=str(i), session_id="night", line_num=i + 1, ts=None, ip=ADDRESS,
                user_name="selma", action="sshd_failed", resource="sshd", status_code=None,
                raw_line=f"ssh door: authentication failure of selma at {ADDRESS}", format="syslog",
                parse_error=None, file_name=None)
            if at is not None:
                row["ts"] = at if isinstance(at, dt.datetime) else T0 + dt.timedelta(seconds=at)
            row.update(change)
            out.append(tuple(row.values()))
        return spark.createDataFrame(out, schemas.LOG_ENTRIES)

    return make


def collect(df):
    return df.orderBy("session_id", "rule_ord", "seq").collect()


def test_ssh_just_above_the_limit(entries):
    found = collect(rules.rule_brute_force_ssh(entries([(30 * i, {}) for i in range(11)])))
    assert len(found) == 1
    f = found[0]
    assert (f.type, f.severity, f.source, f.evidence["count"], len(f.evidence.sampleLines)) == (
        "brute_force_ssh", "high", "rule", 11, 3)
    assert f.title == f"SSH Brute Force Attack Detected from {ADDRESS}"
    assert f.evidence.timeWindow == "5 minutes" and f.evidence.ports is None


@pytest.mark.parametrize("gap, n", [(0, 10), (30, 10), (31, 11), (299, 30)])
def test_ssh_below(entries, gap, n):
    assert collect(rules.rule_brute_force_ssh(entries([(gap * i, {}) for i in range(n)]))) == []


def test_ssh_counts_addresses_and_sessions_apart(entries):
    many = [(7 * i, {"ip": "10.1.0.1"}) for i in range(13)]
    few = [(7 * i, {"ip": "10.1.0.2", "session_id": s}) for i in range(9) for s in ("night", "day")]
    assert [f.evidence.ip for f in collect(rules.rule_brute_force_ssh(entries(few + many)))] == ["10.1.0.1"]


def test_findings_follow_the_first_matching_row(entries):
    late = [(3600 + i, {"ip": "10.1.0.1"}) for i in range(12)]
    early = [(i, {"ip": "10.1.0.2"}) for i in range(12)]
    first = [(0, {"ip": "10.1.0.1"})]  # matches, but its window is not the best
    assert [f.evidence.ip for f in collect(rules.rule_brute_force_ssh(entries(first + early + late)))] == ["10.1.0.1", "10.1.0.2"]
    untimed = [(None, {"ip": "10.1.0.1"})]
    found = collect(rules.rule_brute_force_ssh(entries(untimed + early + late)))
    assert [(f.evidence.ip, f.seq) for f in found] == [("10.1.0.1", 1), ("10.1.0.2", 2)]


@pytest.mark.parametrize("width, label, words", [(300_000, "5 minutes", "5-minute"), (60_000, "1 minute", "1-minute"),
                                                 (86_400_000, "1 day", "1-day"), (7_200_000, "2 hours", "2-hour"), (1_500, "1500 milliseconds", "1500-millisecond")])
def test_texts_name_the_window(entries, width, label, words):
    df = entries([(0, {"status_code": 401, "raw_line": f"ssh failed password port={i}"}) for i in range(3)])
    for rule in (rules.rule_brute_force_ssh, rules.rule_brute_force_web, rules.rule_port_scan):
        f = rule(df, width, 2).first()
        assert f.evidence.timeWindow == label and words in f.description


def test_no_rules_no_findings(entries):
    out = rules.run_rules(entries([(0, {})]), {})
    assert out.collect() == [] and "evidence" in out.columns


def test_untimed_rows_never_anchor(entries):
    epoch = dt.datetime(1970, 1, 1)
    rows = [(None, {})] * 12 + [(epoch, {})] * 12 + [(0, {"ip": ""})] * 12 + [(0, {"ip": None})] * 12
    assert collect(rules.rule_brute_force_ssh(entries(rows))) == []


@pytest.mark.parametrize("n, found", [(20, 0), (21, 1)])
def test_web_threshold(entries, n, found):
    rows = [(i, {"status_code": 401 + 2 * (i % 2), "format": "apache", "action": "GET"}) for i in range(n)]
    assert len(collect(rules.rule_brute_force_web(entries(rows)))) == found


@pytest.mark.parametrize("last, found", [(dt.timedelta(milliseconds=60_000), 1), (dt.timedelta(milliseconds=60_001), 0)])
def test_scan_edge(entries, last, found):
    rows = [(0, {"raw_line": f"port={i}"}) for i in range(20)] + [(T0 + last, {"raw_line": "port=99"})]
    got = collect(rules.rule_port_scan(entries(rows)))
    assert len(got) == found
    if got:
        assert got[0].evidence.distinctPortsCount == 21 and got[0].evidence.ports == list(range(10))


@pytest.mark.parametrize(
    "clock, found",
    [((22, 59, 59), 0), ((23, 0, 0), 1), ((4, 59, 59), 1), ((5, 0, 0), 0)],
)
def test_off_hours_edges(entries, clock, found):
    rows = [(dt.datetime(2025, 9, 3, *clock), {"action": "login", "user_name": ""}), (None, {"action": "login"})]
    got = collect(rules.rule_off_hours_access(entries(rows)))
    assert len(got) == found
    if got:
        assert got[0].evidence.userName == "unknown"
        assert got[0].evidence.timestampUTC == "Wed, 03 Sep 2025 %02d:%02d:%02d GMT" % clock


def test_login_needs_success(entries):
    at = dt.datetime(2025, 9, 3, 1)
    rows = [(at, {"action": "login", "status_code": 401}), (at, {"action": None, "raw_line": "Accepted publickey"}),
            (at, {"action": "login", "status_code": 200})]
    assert [f.seq for f in collect(rules.rule_off_hours_access(entries(rows)))] == [2, 3]


def test_privilege(entries):
    rows = [(0, {"user_name": u, "raw_line": r}) for u, r in [
        ("kai", "SUDO ls"), ("kai", "then su - nobody"), ("kai", "sudo again"), ("lou", "sudo groupadd ops"),
        ("kai", "groupadd ops"), (None, "less /ETC/SUDOERS now"), ("", "grep x /etc/passwd"), ("lou", "ls")]]
    got = [(f.evidence.userName, f.evidence.triggeredPattern, f.evidence.lineNum)
           for f in collect(rules.rule_privilege_escalation(entries(rows)))]
    assert got == [("kai", "sudo", 1), ("kai", "su -", 2), ("lou", "sudo", 4), ("kai", "groupadd", 5),
                   ("unknown", "sudo", 6), ("unknown", "passwd", 7)]


@pytest.mark.parametrize("seed", range(3))
def test_rules_equal_loops(spark, seed):
    """Random rows with ties, gaps on the window edge, untimed rows and a hot address."""
    rng = random.Random(seed)
    base = 1_756_900_000_000
    rows = []
    for i in range(900):
        hot = rng.random() < 0.4
        ms = base + rng.choice([0, 300_000, 600_000]) + rng.choice([0, 1, -1, rng.randrange(300_000)])
        ms = rng.choice([None, 0]) if rng.random() < 0.03 else ms
        port = rng.choice([None, rng.randrange(40)])
        ip = "9.9.9.9" if hot else rng.choice(["1.1.1.1", "2.2.2.2", "", None])
        raw = f"ssh line {i} failed password" + ("" if port is None else f" port={port}")
        rows.append(dict(session=rng.choice("ab"), ip=ip, ms=ms, line=i, raw=raw, port=port))
    df = spark.createDataFrame(
        [(r["session"], r["line"], r["ms"], r["ip"], r["raw"]) for r in rows],
        "session_id string, line_num int, ms bigint, ip string, raw_line string",
    ).select("*", F.timestamp_millis("ms").alias("ts"), F.lit("syslog").alias("format"),
             F.lit(None).cast("string").alias("action"), F.lit(401).alias("status_code"))
    for width, threshold in [[(300_000, 10)], [(60_000, 20)], [(1, 1)]][seed]:
        got = {(f.session_id, f.evidence.ip): (f.evidence["count"], f.evidence.sampleLines)
               for f in rules.rule_brute_force_ssh(df, width, threshold).collect()}
        assert got == loops.count_findings(rows, width, threshold)
        scans = {(f.session_id, f.evidence.ip): (f.evidence.distinctPortsCount, f.evidence.ports, f.evidence.sampleLines)
                 for f in rules.rule_port_scan(df, width, min(threshold, 5)).collect()}
        assert scans == loops.port_findings(rows, width, min(threshold, 5))


def test_break_in_end_to_end(lines):
    """A guessing run of 17 tries, a way in, and two commands."""
    tries = [f"Sep  3 04:{10 + i // 6}:{i % 6 * 10:02d} bastion sshd[{300 + i}]: Failed password for user clerk{i % 4} "
             f"from 198.18.77.5 port {6000 + i}" for i in range(17)]
    after = ["Sep  3 04:20:00 bastion sshd[400]: Accepted password for user clerk2 from 198.18.77.5 port 6100",
             "Sep  3 04:20:30 bastion sudo[401]: less notes, run for clerk2",
             "Sep  3 04:21:00 bastion bash[402]: usermod run for clerk2"]
    parsed = parse_logs(lines(tries + after), 2025)
    assert parsed.count() == 20 and {r.format for r in parsed.select("format").collect()} == {"syslog"}
    found = collect(rules.run_rules(parsed))
    assert [(f.severity, f.title, f.description) for f in found] == [
        ("high", "SSH Brute Force Attack Detected from 198.18.77.5",
         "IP 198.18.77.5 performed 17 failed SSH login attempts within a 5-minute sliding window."),
        ("medium", "Potential Privilege Escalation: clerk2 executing sudo",
         'User "clerk2" executed a command matching privilege escalation signature: "sudo".'),
        ("medium", "Potential Privilege Escalation: clerk2 executing usermod",
         'User "clerk2" executed a command matching privilege escalation signature: "usermod".'),
        ("low", "Off-Hours User Access: clerk2",
         'Successful user login detected during off-hours (23:00 - 05:00 UTC) for user "clerk2".'),
    ]


def test_registered_rule(entries):
    df = entries([(0, {"raw_line": "sudo x"})])
    rules.register_rule("mine", lambda e: rules.rule_privilege_escalation(e, ["x"]))
    try:
        assert sorted(f.evidence.triggeredPattern for f in rules.run_rules(df).collect()) == ["sudo", "x"]
    finally:
        rules.unregister_rule("mine")


def lines_scanned(df, path):
    """Scans of the table at ``path`` in the final plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet [^\n]*" + re.escape(path), final))


def test_rules_scan_the_lines_twice_at_most(spark):
    """Once when the facts or instants are written, once for the texts of the samples."""
    path = tempfile.mkdtemp(prefix="e-") + "/e"  # short, as plans cut long paths
    rows = [("s", i, dt.datetime(2026, 5, 26, 23, 0, i % 60), "9.9.9.9", "u", f"ssh failed password sudo DST={1000 + i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "session_id string, line_num bigint, ts timestamp, ip string, user_name string, raw_line string")
    frame.withColumn("format", F.lit("syslog")).write.parquet(path)
    stored = spark.read.parquet(path)
    for rule in (rules.rule_brute_force_ssh, rules.rule_port_scan, rules.run_rules):
        out = rule(stored)
        assert lines_scanned(out, path) == 1 and out.count() > 0, rule
