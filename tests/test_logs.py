import pytest
from pyspark.sql import functions as F

from spoorlog.operators.chunking import chunk_lines
from spoorlog.plans.ingest import ingest
from spoorlog.session import staged
from spoorlog.sources import logs, tables

SESSION = "11111111-2222-4333-8444-555555555555"
NAMES = [f"{SESSION}_1700000000123_evening.LOG", "plain.txt"]


@pytest.fixture
def folder(tmp_path):
    """Two files with blank lines, carriage returns and no final line feed."""
    content = {}
    for n, name in enumerate(NAMES):
        texts = [("" if i % 7 == 3 else f"line {i} of {n} " + "x" * (i % 50)) for i in range(400)]
        texts[5] = "inner\rreturn"
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes("\r\n".join(texts).encode())
        content[name] = texts
    (tmp_path / "in" / "ignored.bin").write_bytes(b"x\ny")
    return tmp_path, content


@pytest.mark.parametrize("split", ["128m", "1000", "333"])
def test_line_numbers_do_not_depend_on_splits(spark, folder, split):
    path, content = folder
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = logs.with_line_numbers(logs.read_logs(spark, str(path / "in"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.file_name, r.line_num): r.raw_line for r in rows}
    wanted = {(n, i + 1): t for n, texts in content.items() for i, t in enumerate(texts)}
    assert got == wanted and len(rows) == len(wanted)


def test_differing_splits_stop_the_job(spark, folder):
    path, _ = folder
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        numbered = logs.with_line_numbers(logs.read_logs(spark, str(path / "in")))
        spark.conf.set(key, "333")
        with pytest.raises(Exception, match="split differently"):
            numbered.collect()
    finally:
        spark.conf.set(key, old)


def test_session_from_upload_name(spark, folder):
    path, _ = folder
    rows = logs.read_sessions(spark, str(path / "in")).select(
        "session_id", "upload_name", F.unix_millis("upload_ts").alias("ms")).distinct().collect()
    got = {r.upload_name: (r.session_id, r.ms) for r in rows}
    assert got["evening.LOG"] == (SESSION, 1700000000123)
    assert got["plain.txt"][0].endswith("in/plain.txt") and got["plain.txt"][1] is None


def test_ingest_twice_gives_the_same_tables(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    attack = "\n".join(
        [f"Sep  3 14:{10 + i // 6}:{i % 6 * 10:02d} web sshd[9]: Failed password for user u from 198.18.77.5 port {i}"
         for i in range(12)] + ["", "Sep  3 14:20:00 web sudo[1]: less notes"])
    (source / f"{SESSION}_1700000000123_evening.log").write_text(attack)
    (source / "web.log").write_text('10.9.8.7 - - [29/Feb/2024:23:30:00 -0130] "HEAD /a HTTP/1.1" 304 0\nbroken\n')
    for _ in range(2):
        quality = {r.format: (r.parsed, r.failed) for r in ingest(spark, str(source), target, 2025).collect()}
        assert quality == {"syslog": (13, 0), "apache": (1, 1)}
        entries = tables.read_entries(spark, f"{target}/entries", SESSION).collect()
        assert [r.line_num for r in entries] == [*range(1, 13), 14]
        findings = tables.read_findings(spark, f"{target}/findings", SESSION).collect()
        assert [(f.type, f.evidence.ip) for f in findings] == [("brute_force_ssh", "198.18.77.5"), ("privilege_escalation", None)]
        chunks = tables.read_chunks(spark, f"{target}/chunks", SESSION).collect()
        assert [(c.line_start, c.line_end, len(c.embedding)) for c in chunks] == [(1, 14, 1536)]
        assert chunks[0].chunk_text == "\n".join(t for t in attack.split("\n") if t)


def test_incident_report(spark, tmp_path):
    rows = [("s", i, f"title {i}", None if i == 2 else f"10.0.0.{i}") for i in range(1, 6)]
    findings = spark.createDataFrame(rows, "session_id string, seq bigint, title string, ip string").select(
        "session_id", "seq", "title", F.lit(1).alias("rule_ord"), F.lit("high").alias("severity"),
        F.col("title").alias("description"), F.struct("ip").alias("evidence"), F.col("title").alias("id"))
    whole = tables.incident_report(findings, "web-01", "today", "all of it").collect()
    assert len(whole) == 1
    row = spark.createDataFrame(whole).select(
        F.from_json("report", "incidentId string, targetAsset string, analysisDate string, timelineSummary string, "
                    "findings array<struct<severity: string, title: string, description: string, ip: string>>").alias("r")
    ).first().r
    assert (row.incidentId, row.targetAsset, row.timelineSummary) == ("s", "web-01", "all of it")
    assert [(f.title, f.ip) for f in row.findings] == [
        ("title 1", "10.0.0.1"), ("title 2", "Unknown"), ("title 3", "10.0.0.3"), ("title 4", "10.0.0.4"), ("title 5", "10.0.0.5")]
    assert tables.incident_report(findings, "web-01", "today", part_size=2).count() == 3


@pytest.mark.parametrize(
    "n, size, bounds",
    [(0, 75, []), (100, 75, [(1, 75), (61, 100)]), (50, 75, [(1, 50)]), (75, 75, [(1, 75)]), (76, 75, [(1, 75), (61, 76)]),
     (15, 5, [(i, i + 4) for i in range(1, 12)]), (3, 5, [(1, 3)])],
)
def test_chunks(spark, n, size, bounds):
    df = spark.createDataFrame([("s", i, f"line {i}") for i in range(1, n + 1)], "session_id string, line_num int, raw_line string")
    got = chunk_lines(df, size).orderBy("chunk_index").collect()
    assert [(c.line_start, c.line_end) for c in got] == bounds
    assert [c.chunk_index for c in got] == list(range(len(bounds)))
    for c in got:
        assert c.chunk_text == "\n".join(f"line {i}" for i in range(c.line_start, c.line_end + 1))


def test_chunks_across_segments(spark):
    """Gaps in the line numbers and a session longer than one ranking segment."""
    df = spark.range(1, 70_001).select(F.lit("s").alias("session_id"), (F.col("id") * 2).cast("int").alias("line_num"),
                                       F.col("id").cast("string").alias("raw_line"))
    got = chunk_lines(df, 1000, 10).orderBy("chunk_index").collect()
    step, total, at = 990, 70_000, 0
    for i, c in enumerate(got):
        at = i * step
        last = min(at + 1000, total)
        assert (c.chunk_index, c.line_start, c.line_end) == (i, (at + 1) * 2, last * 2)
    assert at + 1000 >= total


def test_staged_table_is_read_back(spark):
    df = staged(spark.range(5).withColumn("id", F.col("id").cast("int")), "numbers")
    assert df.count() == 5 and "Scan parquet" in df._jdf.queryExecution().executedPlan().toString()
