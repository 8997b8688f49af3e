import datetime as dt
import random

from pyspark.sql import functions as F

from spoorlog.functions import predicates as is_
from spoorlog.operators import rules
from spoorlog.operators.sliding import sliding_window_max
from spoorlog.sources import tables
from spoorlog.streaming import keyed, streams

T0 = dt.datetime(2025, 9, 3, 8)
RAW = "session_id string, line_num bigint, ts timestamp, ip string, user_name string, raw_line string"


def entries(df):
    return df.select(
        "*", F.col("line_num").cast("string").alias("id"), F.lit("syslog").alias("format"),
        F.lit(None).cast("string").alias("action"), F.lit(None).cast("int").alias("status_code"))


def arrive(spark, tmp_path, batches):
    """A stream that delivers one file of rows per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    reader = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return entries(reader.parquet(str(tmp_path / "in")))


def finish(df, tmp_path):
    return streams.run_to_end(df, str(tmp_path / "out"), str(tmp_path / "state")).collect()


def test_exact_windows_equal_the_batch_rule(spark, tmp_path):
    """Rows out of order across batches, ties, and one address with most rows."""
    rng = random.Random(11)
    rows = [("s", i, T0 + dt.timedelta(milliseconds=rng.choice([rng.randrange(1_500_000), 1000 * rng.randrange(1500)])),
             "9.9.9.9" if rng.random() < 0.6 else f"1.1.1.{rng.randrange(3)}", "u", "ssh failed password") for i in range(600)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(60)))
    last = ("s", 9999, T0 + dt.timedelta(days=2), "0.0.0.0", "u", "ssh failed password")
    stream = arrive(spark, tmp_path, [rows[:200], rows[200:450], rows[450:], [last]])
    got = finish(streams.stream_brute_force_exact(stream, is_.is_ssh_failure(), 10), tmp_path)
    best = {}
    for r in got:
        best[r.ip] = max(best.get(r.ip, (0, 0)), (r.value, -r.anchor))
    batch = entries(spark.createDataFrame(rows, RAW)).select("session_id", "ip", F.unix_millis("ts").alias("ms"))
    wanted = {r.ip: (r.value, -r.anchor) for r in sliding_window_max(batch, ["session_id", "ip"], 300_000, 10).collect()}
    assert best == wanted and "9.9.9.9" in best


def test_hopping_counts_and_late_rows(spark, tmp_path):
    def row(i, minute):
        return ("s", i, T0 + dt.timedelta(minutes=minute), "1.1.1.1", "u", "ssh invalid user")

    stream = arrive(spark, tmp_path, [[row(i, 0) for i in range(5)], [row(8, 60)], [row(9, 61)], [row(10, 1)], [row(11, 300)]])
    got = finish(streams.stream_rule_counts(stream, is_.is_ssh_failure(), 3), tmp_path)
    assert len(got) == 5 and {r["count"] for r in got} == {5}
    assert min(r.start for r in got) == T0 - dt.timedelta(minutes=4) and max(r.start for r in got) == T0


def test_first_seen_across_batches(spark, tmp_path):
    def row(i, user, raw):
        return ("s", i, T0 + dt.timedelta(seconds=i), "1.1.1.1", user, raw)

    stream = arrive(spark, tmp_path, [
        [row(i, "a", "sudo x") for i in range(20, 40)], [row(i, "a", "sudo x") for i in range(20)], [row(50, "a", "sudo y"), row(51, "a", "su - root"), row(52, "", "sudo")]])
    written = streams.run_to_end(streams.stream_first_seen(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    rows = streams.first_seen(written).collect()
    assert {(r.user, r.pattern): r.line_num for r in rows}["a", "sudo"] == 0
    got = {(r.user, r.pattern) for r in rows}
    assert got == {("a", "sudo"), ("a", "su -"), ("unknown", "sudo")}
    again = streams.run_to_end(streams.stream_first_seen(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert streams.first_seen(again).count() == 3  # nothing new on a second run


def test_off_hours_stream(spark, tmp_path):
    at = dt.datetime(2026, 5, 26, 23, 30)
    stream = arrive(spark, tmp_path, [[("s", 1, at, "1.1.1.1", "u", "Accepted password"), ("s", 2, T0, "1.1.1.1", "u", "Accepted password")]])
    assert [f.seq for f in finish(streams.stream_off_hours(stream), tmp_path)] == [1]


def test_parse_stream_of_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text('1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 1\r\n\nbad\n')
    lines = streams.read_log_stream(spark, str(tmp_path / "logs"), "apache")
    rows = finish(streams.stream_parse(lines, 2026), tmp_path)
    assert sorted((r.ip or "", r.parse_error is None) for r in rows) == [("", False), ("1.1.1.1", True)]
    assert len({r.id for r in rows}) == 2 and rules.run_rules(spark.createDataFrame(rows, streams.stream_parse(lines, 2026).schema)).count() == 0


def test_replay_closes_the_tail(spark, tmp_path):
    """Every window of an ended stream comes out, also those the watermark had not passed."""
    rows = [("s", i, T0 + dt.timedelta(seconds=20 * i), "9.9.9.9", "u", "ssh failed password") for i in range(60)]
    stream = arrive(spark, tmp_path, [rows[:30], rows[30:]])
    build = lambda e: streams.stream_brute_force_exact(e, is_.is_ssh_failure(), 10)
    got = streams.replay(stream, build, str(tmp_path / "out"), str(tmp_path / "state"),
                         {"format": "syslog", "ip": "0.0.0.0", "raw_line": "ssh failed password"}).collect()
    counts = {}
    for i in range(60):
        start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + 20_000 * i
        value = sum(i <= j and 20 * (j - i) <= 300 for j in range(60))
        bucket = start - start % 300_000
        if value > 10 and value > counts.get(bucket, (0, 0))[0]:
            counts[bucket] = (value, start)
    assert {r.bucket: (r.value, r.anchor) for r in got} == counts


def test_alerts_on_the_exceeding_row(spark, tmp_path):
    """One alert per window's length, as soon as the trailing window exceeds; state goes behind the watermark."""
    rows = [("s", i, T0 + dt.timedelta(seconds=10 * i), "9.9.9.9", "u", "ssh failed password") for i in range(100)]
    later = [("s", 999, T0 + dt.timedelta(days=1), "8.8.8.8", "u", "ssh failed password"), ("s", 998, T0 + dt.timedelta(days=1), None, "u", "ssh failed password")]
    stream = arrive(spark, tmp_path, [rows[:12], rows[12:60], rows[60:], later])
    build = keyed.stream_windows(stream, is_.is_ssh_failure(), 10)
    got = finish(build, tmp_path)
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    alerts = sorted((r.anchor, r.value) for r in got if r.kind == "alert")
    assert alerts[0] == (start + 100_000, 11) and len(alerts) == 3
    assert all(b[0] - a[0] > 300_000 for a, b in zip(alerts, alerts[1:]))
    assert {r.bucket for r in got if r.kind == "window"} == {start + 300_000 * k for k in range(4)} - {start + 900_000} | (
        {start + 900_000} if sum(900 <= 10 * i for i in range(100)) > 10 else set())


def test_long_windows_are_kept_in_pieces(spark, tmp_path):
    """Windows longer than a piece of state, rows out of order."""
    rng = random.Random(3)
    rows = [("s", i, T0 + dt.timedelta(milliseconds=rng.randrange(9_000_000)), f"1.1.1.{rng.randrange(2)}", "u", "ssh failed password") for i in range(300)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(300)))
    last = ("s", 9999, T0 + dt.timedelta(days=2), "0.0.0.0", "u", "ssh failed password")
    stream = arrive(spark, tmp_path, [rows[:150], rows[150:], [last]])
    best = {}
    for r in finish(streams.stream_brute_force_exact(stream, is_.is_ssh_failure(), 10, 2_000_000), tmp_path):
        best[r.ip] = max(best.get(r.ip, (0, 0)), (r.value, -r.anchor))
    batch = entries(spark.createDataFrame(rows, RAW)).select("session_id", "ip", F.unix_millis("ts").alias("ms"))
    wanted = {r.ip: (r.value, -r.anchor) for r in sliding_window_max(batch, ["session_id", "ip"], 2_000_000, 10).collect()}
    assert best == wanted and len(best) == 2


def test_first_seen_comes_out_once_and_its_state_ends(spark, tmp_path):
    def row(i, seconds, user, raw):
        return ("s", i, T0 + dt.timedelta(seconds=seconds), "1.1.1.1", user, raw)

    stream = arrive(spark, tmp_path, [
        [row(20, 200, "a", "sudo x"), row(21, 201, "a", "sudo x")], [row(3, 100, "a", "sudo early")], [row(30, 5000, "b", "su - root")],
        [row(31, 6000, "a", "sudo again")], [row(40, 400_000, "", "sudo")], [row(41, 400_100, "a", "sudo late")], [row(50, 900_000, "z", "usermod")]])
    got = finish(keyed.stream_first_seen_closed(stream, quiet_ms=24 * 3_600_000), tmp_path)
    assert sorted((r.user, r.pattern, r.line_num) for r in got) == [
        ("a", "sudo", 3), ("a", "sudo", 41), ("b", "su -", 30), ("unknown", "sudo", 40)]


def test_stream_into_the_job_tables(spark, tmp_path):
    """Micro-batches are found by the tables' readers; a repeated one changes nothing."""
    def row(i):
        return ("s", i, T0 + dt.timedelta(seconds=i), "1.1.1.1", "u", "Accepted password")

    stream, path = arrive(spark, tmp_path, [[row(1), row(2)], [row(3)]]), str(tmp_path / "entries")
    streams.stream_to_job_tables(stream, path, str(tmp_path / "state")).awaitTermination()
    assert [r.line_num for r in tables.read_entries(spark, path, "s").collect()] == [1, 2, 3]
    batch = max(tables.commits(spark, path), key=lambda c: c.seq).batch
    tables.add_entries(tables.read_entries(spark, path), path, batch)
    assert tables.read_entries(spark, path).count() == 3
    streams.stream_to_job_tables(stream, path, str(tmp_path / "state")).awaitTermination()
    assert tables.read_entries(spark, path).count() == 3 and len(tables.commits(spark, path)) == 2
