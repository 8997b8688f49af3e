import datetime as dt
import random

from pyspark.sql import functions as F

from spoorlog import schemas
from spoorlog.operators import chunking, quota, reports, sliding, states
from spoorlog.plans import workload
from spoorlog.sources import tables

EVIDENCE = schemas.EVIDENCE


def finding(spark, rows):
    """Rows of (session, rule_ord, seq, severity, title, evidence fields)."""
    names = list(schemas.EVIDENCE_FIELDS)
    data = [(s, r, q, sev, title, title, "desc", "rule", tuple(ev.get(n) for n in names)) for s, r, q, sev, title, ev in rows]
    return schemas.conform(spark.createDataFrame(
        data, f"session_id string, rule_ord int, seq bigint, severity string, title string, type string, description string, source string, evidence {EVIDENCE}"), schemas.FINDINGS)


def entry(spark, rows):
    """Rows of (session, line, ts, ip)."""
    return schemas.conform(spark.createDataFrame(rows, "session_id string, line_num int, ts timestamp, ip string"), schemas.LOG_ENTRIES)


def at(*clock):
    return dt.datetime(2026, 5, 26, *clock)


def test_quota_equals_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b"]), rng.choice(["x", "y"]), rng.choice([rng.randrange(3000), 1000 * rng.randrange(4)])) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, user_id string, kind string, ms bigint")
    for width in (500, 1000):
        wanted = set()
        for n, user, kind, ms in rows:
            inside = [m for _, u, k, m in rows if (u, k) == (user, kind) and ms - width <= m <= ms]
            if len(inside) > 20:
                wanted.add((n, len(inside), -((ms - width - min(inside)) // 1000)))
        got = {(r.n, r.in_window, r.retry_after) for r in quota.quota_audit(df, 20, width).collect()}
        assert got == wanted and wanted


def test_severities_and_totals(spark):
    f = finding(spark, [("s", 1, 1, "high", "a", {}), ("s", 1, 2, "high", "b", {}), ("s", 5, 3, "low", "c", {}), ("t", 5, 3, "info", "c", {})])
    row = {r.session_id: r for r in reports.severity_matrix(f).collect()}
    assert (row["s"].high_count, row["s"].low_count, row["s"].critical_count, row["t"].info_count) == (2, 1, 0, 1)
    assert {(r.session_id, r.severity, r["count"]) for r in reports.severity_counts(f).collect()} == {("s", "high", 2), ("s", "low", 1), ("t", "info", 1)}
    sessions = spark.createDataFrame([("s", 9), ("t", 9), ("u", None)], "id string, log_count int")
    e = entry(spark, [("s", 1, None, None), ("s", 2, None, None)])
    assert {r.session_id: r.total_events for r in reports.total_events(sessions, e).collect()} == {"s": 2, "t": 9, "u": 0}


def test_histogram_and_timeline(spark):
    e = entry(spark, [("s", 3, at(9, 30), "1.1.1.1"), ("s", 1, at(9, 10) + dt.timedelta(days=1), ""), ("s", 2, None, "x"), ("s", 4, at(9, 30), None)])
    assert [(r.hour, r["count"]) for r in reports.hourly_histogram(e).collect()] == [("09:00", 3)]
    rows = reports.incident_timeline(e, 2).orderBy("rank").collect()
    assert [(r.ts, r.ip, r.action) for r in rows] == [("2026-05-26 09:30:00", "1.1.1.1", "-"), ("2026-05-26 09:30:00", "-", "-")]


def test_top_sources(spark):
    f = finding(spark, [("s", 1, 5, "high", "a", {"ip": "9.9.9.9"}), ("s", 4, 1, "low", "b", {"userName": "u"}), ("s", 4, 2, "low", "b", {"userName": "u"}),
                        ("s", 1, 4, "high", "a", {"ip": "8.8.8.8"}), ("s", 1, 9, "high", "a", {"ip": "7.7.7.7"}), ("t", 1, 1, "high", "a", {"ip": ""})])
    e = entry(spark, [("s", 1, None, "1.1.1.1"), ("t", 2, None, "2.2.2.2"), ("t", 1, None, "3.3.3.3"), ("t", 3, None, "")])
    rows = reports.top_sources(f, e).orderBy("session_id", "rank").collect()
    assert [(r.session_id, r.source, r["count"], r.risk) for r in rows] == [
        ("s", "u", 2, "Primary Target"), ("s", "8.8.8.8", 1, "Suspicious Vector"), ("s", "9.9.9.9", 1, "Suspicious Vector"),
        ("s", "7.7.7.7", 1, "Moderate Interaction"), ("t", "3.3.3.3", 1, "Primary Target"), ("t", "2.2.2.2", 1, "Suspicious Vector")]
    assert reports.top_sources(f, e, 1).count() == 2


def test_indicators(spark):
    f = finding(spark, [
        ("s", 1, 1, "high", "a", {"ip": "1.1.1.1", "ports": [5]}), ("s", 1, 2, "high", "a", {"affectedIps": ["1.1.1.1", "2.2.2.2"]}),
        ("s", 1, 3, "high", "a", {"iocs": (["3.3.3.3"], [22, 22])}), ("s", 1, 4, "high", "a", {})])
    got = {(r.kind, r.value) for r in reports.ioc_summary(f).collect()}
    assert got == {("ip", "1.1.1.1"), ("ip", "2.2.2.2"), ("ip", "3.3.3.3"), ("port", "22")}
    more = {(r.kind, r.value) for r in reports.ioc_summary(f, include_scan_ports=True).collect()}
    assert more - got == {("port", "5")}


def test_finding_views(spark):
    f = finding(spark, [
        ("s", 1, 1, "high", "SSH thing", {"ip": "1.1.1.1", "sampleLines": ["a", "b"], "recommendations": ["act"]}),
        ("s", 4, 2, "medium", "Other", {"affectedIps": ["2.2.2.2"], "rawLine": "raw"}), ("s", 5, 3, "low", "Third", {"userName": "u"})])
    rows = reports.findings_table(f).orderBy("seq").collect()
    assert [(r.severity, r.affected, r.recommendation) for r in rows] == [
        ("HIGH", "1.1.1.1", "act"), ("MEDIUM", "2.2.2.2", "Review system logs configurations."),
        ("LOW", "Unknown/Internal", "Review system logs configurations.")]
    lines = reports.finding_evidence_lines(f).orderBy("seq", "line_pos").collect()
    assert [(r.line_pos, r.line) for r in lines] == [(1, "a"), (2, "b"), (1, "raw"), (1, '{"userName":"u"}')]
    assert [r.seq for r in reports.filter_findings(f, "all", "THIRD").collect()] == [3]
    assert reports.filter_findings(f, "high", "other").count() == 0
    assert reports.filter_findings(f, "high").count() == 1 and reports.filter_findings(f).count() == 3


def test_dashboard(spark):
    sessions = spark.createDataFrame([("s", "n", "completed", 3), ("empty", "e", "pending", 7)], "id string, name string, status string, log_count int")
    f = finding(spark, [("s", 1, 1, "high", "a", {})])
    qa = spark.createDataFrame([("s",), ("s",)], "session_id string")
    rows = {r.session_id: r for r in reports.session_dashboard(sessions, entry(spark, [("s", 1, None, None)]), f, qa).collect()}
    assert (rows["s"].entries, rows["s"].findings, rows["s"].answers, rows["s"].high_count, rows["s"].total_events) == (1, 1, 2, 1, 1)
    assert (rows["empty"].entries, rows["empty"].high_count, rows["empty"].total_events) == (0, 0, 7)


def test_findings_round_trip(spark, tmp_path):
    f = finding(spark, [("s", 1, 1, "high", "a", {"ip": "1.1.1.1", "iocs": (["x"], [1])}), ("t", 1, 1, "high", "b", {})]).withColumn(
        "source", F.when(F.col("session_id") == "s", "ml"))
    for _ in range(2):
        tables.write_findings(f, str(tmp_path / "f"))
    rows = {r.session_id: r for r in tables.read_findings(spark, str(tmp_path / "f")).collect()}
    assert len(rows) == 2 and rows["s"].evidence.iocs.ports == [1] and rows["s"].source == "ml" and rows["t"].source == "rule"


def test_upsert(spark):
    base = spark.createDataFrame([("1", "a@x", "Ann", "i.png", at(1)), ("2", "b@x", "Bob", None, at(2))], schemas.USERS.replace("name string, email string", "email string, name string"))
    new = spark.createDataFrame([("a@x", "Anna", "", 1, at(5)), ("c@x", "Cy", "c.png", 1, at(6)), ("c@x", None, "d.png", 2, at(7)), ("a@x", "Old", "o", 0, at(4))],
                                "email string, name string, image string, version int, created_at timestamp")
    rows = {r.email: r for r in states.upsert_by_key(base, new).collect()}
    assert (rows["a@x"].id, rows["a@x"].name, rows["a@x"].image, rows["a@x"].created_at) == ("1", "Anna", None, at(1))
    assert (rows["b@x"].name, rows["c@x"].name, rows["c@x"].image, rows["c@x"].created_at) == ("Bob", None, "d.png", at(6))
    assert tables.user_by_email(base, "b@x").first().name == "Bob"


def test_session_states(spark):
    sessions = spark.createDataFrame([("s", "u", "pending", 0, at(1), at(0)), ("t", "u", None, None, at(1), at(3))],
                                     "id string, user_id string, status string, log_count int, updated_at timestamp, created_at timestamp")
    updates = spark.createDataFrame([("s", "processing", 15, at(2)), ("s", "completed", None, at(3)), ("zz", "failed", None, at(3))],
                                    "id string, status string, log_count int, updated_at timestamp")
    rows = {r.id: r for r in states.latest_session_state(sessions, updates).collect()}
    assert (rows["s"].status, rows["s"].log_count, rows["s"].updated_at) == ("completed", 15, at(3))
    assert (rows["t"].status, rows["t"].log_count, rows["t"].updated_at) == ("pending", 0, at(1))
    assert [r.id for r in states.unknown_updates(sessions, updates).collect()] == ["zz"]
    assert [r.id for r in tables.sessions_of_user(sessions, "u").collect()] == ["t", "s"]
    assert tables.session_by_id(sessions, "s").count() == 1
    rows = spark.createDataFrame([("s", 1), ("q", 2)], "session_id string, n int")
    assert [r.n for r in states.keep_valid_sessions(rows, sessions).collect()] == [1]
    assert [r.n for r in states.orphans(rows, sessions).collect()] == [2]


def test_quota_in_pieces_equals_loop(spark, monkeypatch):
    """Windows longer than a piece, one user with most rows: no task sees more than a piece of it."""
    monkeypatch.setattr(sliding, "PIECE_MS", 100)
    rng = random.Random(4)
    rows = [(i, "a" if rng.random() < 0.7 else "b", "x", rng.choice([rng.randrange(6000), 700 * rng.randrange(8)])) for i in range(400)]
    df = spark.createDataFrame(rows, "n int, user_id string, kind string, ms bigint")
    for width in (150, 1000, 2500):
        wanted = set()
        for n, user, kind, ms in rows:
            inside = [m for _, u, k, m in rows if (u, k) == (user, kind) and ms - width <= m <= ms]
            if len(inside) > 15:
                wanted.add((n, len(inside), -((ms - width - min(inside)) // 1000)))
        got = {(r.n, r.in_window, r.retry_after) for r in quota.quota_audit(df, 15, width).collect()}
        assert got == wanted and wanted
    spans = df.select("user_id", "kind", "n", F.col("ms").alias("at"), F.lit(1).alias("delta"), F.lit(True).alias("point"), sliding.bucket_of(F.col("ms"), 2500).alias("bucket"))
    cut = sliding.carried_in(spans, ["user_id", "kind", "bucket"], "at", F.sum("delta"), {"delta": F.sum("part")})
    sizes = [r["count"] for r in cut.groupBy("user_id", "kind", "bucket", "piece").count().collect()]
    assert max(sizes) <= 1 + max(sum(u == "a" and m // 100 == p for _, u, _, m in rows) for p in range(60))


def test_distinct_values_in_pieces_equal_loop(spark, monkeypatch):
    monkeypatch.setattr(sliding, "PIECE_MS", 100)
    rng = random.Random(6)
    rows = [("a" if rng.random() < 0.7 else "b", rng.randrange(12), rng.randrange(5000)) for _ in range(300)]
    df = spark.createDataFrame(rows, "ip string, port int, ms bigint")
    for width in (900, 2100):
        best = {}
        for ip, _, at in rows:
            value = len({p for i, p, m in rows if i == ip and at <= m <= at + width})
            best[ip] = max(best.get(ip, (0, 0)), (value, -at))
        got = {r.ip: (r.value, -r.anchor) for r in sliding.sliding_window_max(df, ["ip"], width, 3, "port").collect()}
        assert got == {k: v for k, v in best.items() if v[0] > 3}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_tables_without_rewrites_are_read_without_a_join(spark, tmp_path):
    path = str(tmp_path / "e")
    tables.write_entries(entry(spark, [("s", 1, at(1), "1.1.1.1"), ("t", 1, at(1), None)]), path)
    tables.write_entries(entry(spark, [("u", 1, at(2), "x")]), path)
    fresh = tables.read_entries(spark, path)
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString() and shuffles(fresh) == 0
    tables.write_entries(entry(spark, [("s", 5, at(3), "y"), ("s", 6, at(3), "y")]), path)
    rewritten = tables.read_entries(spark, path)
    assert sorted((r.session_id, r.line_num) for r in rewritten.collect()) == [("s", 5), ("s", 6), ("t", 1), ("u", 1)]
    assert "Join" in rewritten._jdf.queryExecution().optimizedPlan().toString()
    tables.compact(spark, path)
    after = tables.read_entries(spark, path)
    assert "Join" not in after._jdf.queryExecution().optimizedPlan().toString() and len(tables.commits(spark, path)) == 1
    assert sorted((r.session_id, r.line_num) for r in after.collect()) == [("s", 5), ("s", 6), ("t", 1), ("u", 1)]
    assert tables.expire(spark, path) == 3 and tables.expire(spark, path) == 3 and after.count() == 4
    tables.write_entries(entry(spark, [("t", 9, at(4), "z")]), path)
    assert sorted((r.session_id, r.line_num) for r in tables.read_entries(spark, path).collect()) == [("s", 5), ("s", 6), ("t", 9), ("u", 1)]


def test_a_write_that_dies_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "e")
    tables.write_entries(entry(spark, [("s", 1, at(1), "1.1.1.1")]), path)
    bad = entry(spark, [("s", 2, at(1), "x")]).withColumn("raw_line", F.raise_error(F.lit("lost")).cast("string"))
    for _ in range(2):
        try:
            tables.write_entries(bad, path)
        except Exception:  # noqa: BLE001
            pass
    assert [r.line_num for r in tables.read_entries(spark, path).collect()] == [1] and len(tables.commits(spark, path)) == 1


def test_deleted_sessions_leave_every_table(spark, tmp_path):
    target = str(tmp_path)
    rows = entry(spark, [("s", 1, at(1), "x"), ("t", 1, at(1), "y")])
    sessions = spark.createDataFrame([("s", "u"), ("t", "u")], "id string, user_id string")
    for _ in range(2):
        tables.write_entries(rows, f"{target}/entries")
    tables.write_findings(finding(spark, [("s", 1, 1, "high", "a", {}), ("t", 1, 1, "high", "b", {})]), f"{target}/findings")
    tables.write_sessions(sessions, f"{target}/sessions")
    gone = spark.createDataFrame([("s",), ("s",), ("other",), (None,)], "session_id string")
    for _ in range(2):
        tables.delete_sessions(gone, target)
        held = [tables.read_entries(spark, f"{target}/entries"), tables.read_findings(spark, f"{target}/findings"),
                tables.read_sessions_table(spark, f"{target}/sessions").withColumn("session_id", F.col("id"))]
        assert [[r.session_id for r in df.collect()] for df in held] == [["t"]] * 3
        assert tables.read_entries(spark, f"{target}/entries", "s").count() == 0
    tables.write_entries(rows.filter("session_id = 's'"), f"{target}/entries")
    assert tables.read_entries(spark, f"{target}/entries").count() == 2


def test_ingest_tables_embeds_its_chunks(spark, tmp_path, monkeypatch):
    """the chunks that the query's ingest stores bear the embedding of their own text, not one constant vector."""
    rows = [(i, f"2024-01-{1 + i // 90:02d} 10:00:00", i % 7, ("error", "view", "click")[i % 3], 1.0, f'{{"k": {i}}}') for i in range(180)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/data/events.parquet")
    monkeypatch.setattr(workload, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    held = {r.day: r.chunk_count for r in workload.ingest_tables(spark, f"{tmp_path}/data").collect()}
    assert held == {"day-2024-01-01": 2, "day-2024-01-02": 2}
    stored = tables.read_chunks(spark, f"{tmp_path}/ingest/tables/chunks")
    wanted = chunking.embed_hashed(stored.drop("embedding")).select("id", F.col("embedding").alias("wanted"))
    got = stored.join(wanted, "id").collect()
    assert len(got) == 4 and all(len(r.embedding) == chunking.EMBEDDING_SIZE and r.embedding == r.wanted for r in got)
    assert len({tuple(r.embedding) for r in got}) == 4
