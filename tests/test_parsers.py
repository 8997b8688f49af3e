import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spoorlog.functions import dates, text
from spoorlog.operators import formats, parsers


def ms(row):
    return None if row.ts is None else int(row.ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def millis(df):
    return [r for r in df.withColumn("ms", F.unix_millis("ts")).orderBy("line_num").collect()]


def utc_ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_syslog(lines):
    rows = millis(
        parsers.parse_syslog(
            lines(
                [
                    "<86>Mar  4 07:08:09 gate-7 doas[42]: authentication error for user petra.k at /srv/vault/open now",
                    "<165>1 2025-11-02T03:04:05.678Z relay.lan smtpd 77 M9 - relay denied, username=mira from 172.20.8.9:2525",
                    "Dec 31 23:59:59 nas-2 zed: pool scrub exit=17 success",
                    "pool scrub finished without a stamp",
                    "  ",
                    "<7>1 2025-11-02T03:04:05-02:00 relay.lan - 1 M [k v] noted",
                    "<7>1 2025-11-02T03:04:05Z relay.lan - 1 M -",
                    "Jun 31 10:00:00 nas-2 cron: accepted",
                ]
            ),
            2025,
        )
    )
    assert [r.line_num for r in rows] == [1, 2, 3, 4, 6, 7, 8]
    a, b, c, bad, d, e, f = rows
    assert (a.user_name, a.action, a.resource, a.ip, a.status_code, a.parse_error) == (
        "petra.k", "doas_failed", "/srv/vault/open", None, None, None)
    assert a.ms == utc_ms(2025, 3, 4, 7, 8, 9)
    assert (b.user_name, b.ip, b.action, b.resource) == ("mira", "172.20.8.9", "smtpd", "smtpd")
    assert b.ms == utc_ms(2025, 11, 2, 3, 4, 5) + 678
    assert (c.action, c.resource, c.status_code) == ("zed_success", "zed", 17)
    assert "does not match RFC 5424 or RFC 3164" in bad.parse_error and bad.action is None
    assert (d.action, d.resource, d.ms) == ("event", None, utc_ms(2025, 11, 2, 5, 4, 5))
    assert (e.action, e.parse_error) == ("event", None)
    assert (f.action, f.ts) == ("cron_success", None)


def test_access(lines):
    rows = millis(
        parsers.parse_access_log(
            lines(
                [
                    '10.9.8.7 - nora [29/Feb/2024:23:30:00 -0130] "HEAD /feed.xml HTTP/1.1" 304 0',
                    '172.31.0.4 x - [01/Jan/2025:00:15:00 +0900] "PUT /cart/9?v=2 HTTP/1.1" 403 17 "-" "probe 3"',
                    'fe80::2 - olga [05/Jul/2025:12:00:00 +0000] "PATCH /rooms HTTP/2.0" 202 1',
                    '10.9.8.7 - - yesterday "HEAD /" 304',
                    '- - - [nonsense] "" 500 -',
                ]
            )
        )
    )
    a, b, c, bad, odd = rows
    assert (a.ip, a.user_name, a.action, a.resource, a.status_code) == ("10.9.8.7", "nora", "HEAD", "/feed.xml", 304)
    assert a.ms == utc_ms(2024, 3, 1, 1, 0, 0)
    assert (b.user_name, b.action, b.status_code, b.ms) == (None, "PUT", 403, utc_ms(2024, 12, 31, 15, 15, 0))
    assert (c.ip, c.action, c.status_code) == ("fe80::2", "PATCH", 202)
    assert bad.parse_error and bad.status_code is None
    assert (odd.ip, odd.action, odd.resource, odd.ts, odd.status_code, odd.parse_error) == (
        None, None, None, None, 500, None)


def audit(**fields):
    return json.dumps({"eventTime": "2025-08-09T10:11:12Z", "eventSource": "vault.example.net", **fields})


def test_audit(lines):
    rows = millis(
        parsers.parse_audit_json(
            lines(
                [
                    audit(eventName="OpenVault", sourceIPAddress="198.18.0.7", userIdentity={"userName": "ines"}),
                    audit(eventName="ReadKey", userIdentity={"arn": "arn:x:role/tomas"}, errorCode="UnauthorizedOperation") + ",",
                    '{"eventName": "Seal", "userIdentity": {"principalId": "P1:night", "userName": ""}, "errorCode": "Busy"}',
                    audit(eventName="Cut")[:-5],
                    '{"weather": "fine"}',
                    "[3, 4]",
                    '{"eventName": "First", "eventName": "Second", "userIdentity": {"userName": "a", "userName": "b"}}',
                ]
            )
        )
    )
    a, b, c, broken, other, array, twice = rows
    assert (a.ip, a.user_name, a.action, a.resource, a.status_code) == ("198.18.0.7", "ines", "OpenVault", "vault.example.net", 200)
    assert a.ms == utc_ms(2025, 8, 9, 10, 11, 12)
    assert (b.user_name, b.status_code) == ("arn:x:role/tomas", 403)
    assert (c.user_name, c.status_code, c.ts) == ("P1:night", 400, None)
    assert broken.parse_error == "Invalid JSON" and broken.status_code is None
    for row in (other, array):
        assert "does not appear" in row.parse_error and row.status_code is None
    assert (twice.action, twice.user_name, twice.parse_error) == ("Second", "b", None)  # the last of equal keys


def test_key_value_and_text(lines):
    rows = millis(
        parsers.parse_kv(
            lines(
                [
                    'date="2025-02-03T04:05:06Z" src=10.4.4.4 usr=lea method=rename code=204 info="done"',
                    "eventtime=1700000000123 client=10.5.5.5 username='ada l' event_name=\"export\" uri='/out/a.zip' statuscode=507",
                    "backup of 10.6.6.6 hit an error at block 9",
                    "SRC=10.7.7.7 src='10.8.8.8' status=302moved user=\"\" usr=z message=hey, ts=1700000000",
                    "all is quiet",
                    "connected, fine",
                    "ts ip =a",
                ]
            )
        )
    )
    a, b, c, d, quiet, joined, spaced = rows
    assert (a.ip, a.user_name, a.action, a.status_code, a.ms) == ("10.4.4.4", "lea", "rename", 204, utc_ms(2025, 2, 3, 4, 5, 6))
    assert (b.ip, b.user_name, b.action, b.resource, b.status_code, b.ms) == (
        "10.5.5.5", "ada l", "export", "/out/a.zip", 507, 1700000000123)
    assert (c.ip, c.action, c.user_name, c.resource, c.parse_error) == ("10.6.6.6", "error", None, None, None)
    assert (d.ip, d.status_code, d.user_name, d.action, d.ms) == ("10.8.8.8", 302, "", "hey,", 1700000000000)
    assert (quiet.action, joined.action) == ("log", "info")
    assert (spaced.ip, spaced.action, spaced.ts) == ("a", None, None)


def test_detect_format(spark, lines):
    cases = {
        "syslog": ["<86>Mar  4 07:08:09 gate-7 doas[42]: noted", "Mar  4 07:08:10 gate-7 cron: run"],
        "apache": ['10.9.8.7 - - [29/Feb/2024:23:30:00 -0130] "HEAD / HTTP/1.1" 304 0'],
        "cloudtrail": [audit(eventName="ReadKey")],
        "generic": ["date=2025-02-03 src=10.4.4.4 code=9"],
    }
    extra = {
        "blank": (["", "  "], "generic"),
        "firewall": (["<4>May 26 12:00:00 fw kernel: IN=a OUT=b SRC=1.1.1.1 DST=2 LEN=3 TTL=4"], "generic"),
        "any-json": (['{"a": 1}', "[1]"], "cloudtrail"),
        "late": (["x"] * 5 + cases["apache"] * 9, "generic"),
        "blank-first": (["", " "] * 40 + cases["apache"], "apache"),
    }
    wanted = {k: k for k in cases} | {k: v[1] for k, v in extra.items()}
    df = None
    for name, texts in {**cases, **{k: v[0] for k, v in extra.items()}}.items():
        part = lines(texts, name)
        df = part if df is None else df.union(part)
    got = {r.session_id: r.format for r in formats.detect_format(df).collect()}
    assert got == wanted


def test_parse_logs_uses_one_format_per_session(lines):
    content = [
        "",
        '\t 10.9.8.7 - nora [29/Feb/2024:23:30:00 -0130] "HEAD /feed.xml HTTP/1.1" 304 0 ',
        ' 172.31.0.4 - - [01/Jan/2025:00:15:00 +0900] "PUT /cart/9 HTTP/1.1" 403 17',
        " \t",
        "not a request",
    ]
    df = lines(content, "web").union(lines(["status=1 ip=2", "plain"], "kv"))
    rows = parsers.parse_logs(df, 2025).orderBy("session_id", "line_num").collect()
    assert [(r.session_id, r.line_num, r.format) for r in rows] == [
        ("kv", 1, "generic"), ("kv", 2, "generic"),
        ("web", 2, "apache"), ("web", 3, "apache"), ("web", 5, "apache"),
    ]
    assert [r.user_name for r in rows[2:]] == ["nora", None, None]
    assert rows[4].parse_error and rows[2].raw_line.startswith("\t 10.9")
    assert len({r.id for r in rows}) == 5


def test_validation(lines):
    entries = parsers.parse_syslog(lines(["nothing", "Mar 14 01:02:03 h a: b"]), 2025)
    good, bad = parsers.split_valid(parsers.validate_entries(entries))
    assert good.count() == 1 and bad.count() == 1
    broken = entries.withColumn("id", F.lit("x")).withColumn("status_code", F.lit(1.5))
    errors = [r.parse_error for r in parsers.validate_entries(broken).orderBy("line_num").collect()]
    assert errors[0].startswith("Line does not match") and "; Schema: id is not a uuid" in errors[0]
    assert errors[1] == "Schema: id is not a uuid; Schema: status_code is not an integer"


@pytest.mark.parametrize(
    "line, port, strict",
    [
        ("SRC=1.2.3.4 DST=203.0.113.5 DPT=22", 203, 22),
        ("dst=8080 port=1", 8080, 8080),
        ("failed from 1.1.1.1 port 49152 ssh2", 49152, 49152),
        ("at 12:00:01 nothing", 0, None),
        ("http://host:80/path", 80, 80),
        ("transport: 5", 5, None),
        ("no port", None, None),
        (":12ab x:7", 7, 7),
        ("port=12345678901234567890", 12345678901234567890.0, 12345678901234567890.0),
    ],
)
def test_destination_port(spark, line, port, strict):
    df = spark.createDataFrame([(line,)], "raw string")
    row = df.select(
        text.extract_destination_port(F.col("raw")).alias("p"),
        text.extract_destination_port(F.col("raw"), strict=True).alias("q"),
    ).first()
    assert (row.p, row.q) == (port, strict)


def test_text_helpers(spark):
    df = spark.createDataFrame([("﻿  a ", "é1.2.3.4 x1.2.3.4 (5.6.7.8)", "a😀b")], "a string, b string, c string")
    row = df.select(
        text.trim(F.col("a")).alias("a"), text.extract_ipv4(F.col("b")).alias("b"),
        text.utf16_length(F.col("c")).alias("c"),
    ).first()
    # an accented letter is no word character for the address pattern
    assert (row.a, row.b, row.c) == ("a", "1.2.3.4", 4)


@pytest.mark.parametrize(
    "value, wanted",
    [
        ("1779811135", 1779811135000),
        ("1779811135123", 1779811135123),
        ("2025-03-14", utc_ms(2025, 3, 14)),
        ("2025-03-14T01:02:03.456789Z", utc_ms(2025, 3, 14, 1, 2, 3) + 456),
        ("2025-03-14 01:02:03", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("Fri, 14 Mar 2025 01:02:03 GMT", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("2025/03/14 01:02:03", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("2025/3/4", utc_ms(2025, 3, 4)),
        ("March 14, 2025 01:02:03", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("Mar 14, 2025", utc_ms(2025, 3, 14)),
        ("14 Mar 2025 01:02", utc_ms(2025, 3, 14, 1, 2)),
        ("03/14/2025 1:02:03 PM", utc_ms(2025, 3, 14, 13, 2, 3)),
        ("3/4/2025", utc_ms(2025, 3, 4)),
        ("Fri Mar 14 2025 01:02:03 GMT+0000 (Coordinated Universal Time)", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("Fri Mar 14 2025 01:02:03 GMT-0330", utc_ms(2025, 3, 14, 4, 32, 3)),
        ("14 Mar 2025 06:32:03 +0530", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("Mar 14, 2025 01:02:03 UTC", utc_ms(2025, 3, 14, 1, 2, 3)),
        ("2025-3-4 1:02:03", utc_ms(2025, 3, 4, 1, 2, 3)),
        ("2025-3-4", utc_ms(2025, 3, 4)),
        ("Mar 34, 2025", None),
        ("13/14/2025", None),
        ("12:00", None),
        ("soon", None),
        ("2025-02-30", None),
    ],
)
def test_dates(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(F.unix_millis(dates.parse_epoch_or_date(F.col("v"))).alias("m")).first().m == wanted


def test_sniff_by_name(spark):
    cases = [
        ("a.JSON", "x", "cloudtrail"), ("a.log", '{"a"', "cloudtrail"), ("a", '"Events":', "cloudtrail"),
        ("a.log", "<34>x", "syslog"), ("a.log", "x sshd[1]", "syslog"), ("a", "my syslog", "syslog"),
        ("a.log", 'x "GET / HTTP/1.1"', "apache"), ("a.csv", "a,b", "generic"),
    ]
    df = spark.createDataFrame([(n, l) for n, l, _ in cases], "n string, l string")
    got = [r.f for r in df.select(formats.sniff_by_name(F.col("n"), F.col("l")).alias("f")).collect()]
    assert got == [w for _, _, w in cases]
