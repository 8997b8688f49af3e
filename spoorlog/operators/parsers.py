"""Lines to ``log_entries`` rows, in native column expressions only.

Every parser adds its working columns in steps, so that each regex runs once per
line, and yields the output columns. ``when`` restricts the work to the lines of
the parser's own format; :func:`parse_logs` chains all four over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorlog import schemas
from spoorlog.functions import patterns as P
from spoorlog.functions.dates import (
    parse_access_date,
    parse_bsd,
    parse_date,
    parse_epoch_or_date,
    parse_iso,
)
from spoorlog.functions.text import (
    captures,
    extract_ipv4,
    first_match,
    has_any,
    leading_int,
    non_empty,
    stable_uuid,
    trim,
)
from spoorlog.operators.formats import detect_format, file_keys, present, without_trailing_comma
from spoorlog.session import staged
from spoorlog.sources.logs import non_blank

PARSED = ["ts", "ip", "user_name", "action", "resource", "status_code", "parse_error"]
LINE = ["session_id", "line_num", "raw_line"]

Columns = dict[str, Column]


def _missing() -> Column:
    return F.lit(None).cast("string")


def _syslog(df: DataFrame, when: Column, year: int) -> tuple[DataFrame, Columns]:
    priority = F.startswith(F.col("trimmed"), F.lit("<"))  # no RFC 5424 line begins otherwise
    df = df.withColumn("s5424", F.when(when & priority, captures(F.col("trimmed"), P.RFC5424, [3, 5, 9])))
    is_5424 = F.size("s5424") == 3
    df = df.withColumn(
        "sys", F.when(is_5424, F.col("s5424")).when(when, captures(F.col("trimmed"), P.BSD, [2, 4, 6]))
    )
    known = F.size("sys") == 3
    app = F.when(is_5424, F.nullif(F.get("sys", F.lit(1)), F.lit("-"))).otherwise(
        trim(F.get("sys", F.lit(1)))
    )
    df = df.withColumns(
        {
            "sys_stamp": F.when(known, F.get("sys", F.lit(0))),
            "sys_app": F.when(known, app),
            "sys_msg": F.when(known, F.get("sys", F.lit(2))),
        }
    ).withColumn("sys_lower", F.lower("sys_msg"))
    stamp, msg, lower = F.col("sys_stamp"), F.col("sys_msg"), F.col("sys_lower")
    iso = F.contains(stamp, F.lit("-")) & F.contains(stamp, F.lit("T"))
    outcome = lambda word: F.coalesce(
        F.concat(non_empty(F.col("sys_app")), F.lit("_" + word)), F.lit(word)
    )
    action = (
        F.when(has_any(lower, P.FAILURE_WORDS), outcome("failed"))
        .when(has_any(lower, P.SUCCESS_WORDS), outcome("success"))
        .otherwise(F.coalesce(non_empty(F.col("sys_app")), F.lit("event")))
    )
    return df, {
        "ts": F.when(iso, parse_iso(stamp)).otherwise(parse_bsd(stamp, year)),
        "ip": extract_ipv4(msg),
        "user_name": first_match(msg, P.USER, 1),
        "action": F.when(msg.isNotNull(), action),
        "resource": F.coalesce(first_match(msg, P.PATH, 1, needs="/"), F.col("sys_app")),
        "status_code": first_match(msg, P.EXIT_STATUS, 1, needs="=").try_cast("int"),
        "parse_error": F.when(msg.isNull(), F.lit(P.SYSLOG_ERROR)),
    }


def _access(df: DataFrame, when: Column) -> tuple[DataFrame, Columns]:
    df = df.withColumn("acc", F.when(when, captures(F.col("trimmed"), P.ACCESS, [1, 3, 4, 6, 5])))
    known = F.size("acc") == 5
    part = lambda i: F.when(known, F.get("acc", F.lit(i)))
    df = df.withColumn("acc_request", F.split(non_empty(part(4)), P.java(r"\s+")))
    return df, {
        "ts": parse_access_date(part(2)),
        "ip": F.nullif(part(0), F.lit("-")),
        "user_name": F.nullif(part(1), F.lit("-")),
        "action": F.get("acc_request", F.lit(0)),
        "resource": F.get("acc_request", F.lit(1)),
        "status_code": part(3).try_cast("int"),
        "parse_error": F.when(F.size("acc") != 5, F.lit(P.ACCESS_ERROR)),
    }


def _audit(df: DataFrame, when: Column) -> tuple[DataFrame, Columns]:
    json = F.try_parse_json(without_trailing_comma(F.col("trimmed")))
    df = df.withColumn("aud", F.when(when, json))
    field = lambda path: present(F.col("aud"), path)
    df = df.withColumns(
        {
            "aud_time": field("$.eventTime"),
            "aud_name": field("$.eventName"),
            "aud_source": field("$.eventSource"),
            "aud_error": field("$.errorCode"),
        }
    )
    known = F.coalesce("aud_time", "aud_name", "aud_source").isNotNull()
    only = lambda col: F.when(known, col)
    status = (
        F.when(F.col("aud_error").isin("AccessDenied", "UnauthorizedOperation"), 403)
        .when(F.col("aud_error").isNotNull(), 400)
        .otherwise(200)
    )
    user = F.coalesce(*[field(f"$.userIdentity.{n}") for n in ("userName", "arn", "principalId")])
    return df, {
        "ts": parse_date(F.col("aud_time")),
        "ip": only(field("$.sourceIPAddress")),
        "user_name": only(user),
        "action": F.col("aud_name"),
        "resource": F.col("aud_source"),
        "status_code": only(status),
        "parse_error": F.when(F.col("aud").isNull(), F.lit(P.JSON_ERROR)).when(
            ~known, F.lit(P.AUDIT_ERROR)
        ),
    }


def _generic(df: DataFrame, when: Column) -> tuple[DataFrame, Columns]:
    # One rewrite leaves: text, key, value, text, key, value, … , text. A key
    # starts where a word starts, which spares a try at each of its letters.
    word_start = r"(?<![a-zA-Z0-9_\-\.])"
    marked = F.regexp_replace("raw_line", word_start + P.java(P.KEY_VALUE), "\n$1\n$2$3$4\n")
    df = df.withColumn("kv", F.when(when, F.split(marked, "\n")))
    pick = lambda at: F.reverse(F.filter("kv", lambda x, i: i % 3 == at))
    df = df.withColumns(
        {"kv_keys": F.transform(pick(1), F.lower), "kv_values": pick(2)}
    ).withColumn("kv_lower", F.when(F.size("kv") == 1, F.lower("raw_line")))

    def value(names: list[str]) -> Column:
        """Value of the first alias present; its last occurrence wins."""
        aliases = F.array(*[F.lit(n) for n in names])
        first = F.get(F.filter(aliases, lambda n: F.array_contains("kv_keys", n)), F.lit(0))
        return F.get("kv_values", (F.array_position("kv_keys", first) - 1).cast("int"))

    lower = F.col("kv_lower")
    spoken = (
        F.when(has_any(lower, ["fail", "error"]), "error")
        .when(has_any(lower, ["success", "login", "connect"]), "info")
        .otherwise("log")
    )
    plain = F.size("kv") == 1
    df = df.withColumn("kv_ts", value(P.TS_KEYS))
    return df, {
        "ts": parse_epoch_or_date(F.col("kv_ts")),
        "ip": F.when(plain, extract_ipv4(F.col("raw_line"))).otherwise(value(P.IP_KEYS)),
        "user_name": value(P.USER_KEYS),
        "action": F.when(plain, spoken).otherwise(value(P.ACTION_KEYS)),
        "resource": value(P.RESOURCE_KEYS),
        "status_code": leading_int(value(P.STATUS_KEYS)),
        "parse_error": _missing(),
    }


def _entries(df: DataFrame, fmt: Column, parsed: Columns) -> DataFrame:
    """Output rows; lines without a number, as on a stream, are named by their text."""
    line = F.coalesce(F.col("line_num").cast("string"), F.col("raw_line"))
    out = df.select(
        stable_uuid(F.col("session_id"), F.col("file_name"), line).alias("id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.col("line_num").cast("bigint").alias("line_num"),
        F.col("file_name"),
        *[parsed[name].alias(name) for name in PARSED],
        F.col("raw_line"),
        fmt.alias("format"),
    )
    return schemas.conform(out, schemas.LOG_ENTRIES)


def _lines(lines: DataFrame, *more: str) -> DataFrame:
    """The columns parsers read; lines without a file name are their session's only file."""
    file = F.col("file_name") if "file_name" in lines.columns else _missing().alias("file_name")
    return non_blank(lines.select(*LINE, file, *more))


def _one_format(lines: DataFrame, name: str, parser, *args) -> DataFrame:
    df = _lines(lines).withColumn("trimmed", trim(F.col("raw_line")))
    df, parsed = parser(df, F.lit(True), *args)
    return _entries(df, F.lit(name), parsed)


def parse_syslog(lines: DataFrame, default_year: int) -> DataFrame:
    """RFC 5424 first, then BSD syslog; BSD stamps get ``default_year`` in UTC."""
    return _one_format(lines, "syslog", _syslog, default_year)


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Common and combined web access logs."""
    return _one_format(lines, "apache", _access)


def parse_audit_json(lines: DataFrame) -> DataFrame:
    """Cloud audit events, one JSON object per line."""
    return _one_format(lines, "cloudtrail", _audit)


def parse_kv(lines: DataFrame) -> DataFrame:
    """``key=value`` lines, and free text where a line has no pair."""
    return _one_format(lines, "generic", _generic)


parse_plain_text = parse_kv


def parse_with_format(lines: DataFrame, default_year: int) -> DataFrame:
    """Parse lines that already carry a ``format`` column. Stateless."""
    df = _lines(lines, "format").withColumn("trimmed", trim(F.col("raw_line")))
    is_format = lambda name: F.col("format") == name
    df, syslog = _syslog(df, is_format("syslog"), default_year)
    df, access = _access(df, is_format("apache"))
    df, audit = _audit(df, is_format("cloudtrail"))
    df, generic = _generic(df, is_format("generic"))
    merged = {
        name: F.when(is_format("syslog"), syslog[name])
        .when(is_format("apache"), access[name])
        .when(is_format("cloudtrail"), audit[name])
        .otherwise(generic[name])
        for name in PARSED
    }
    return _entries(df, F.col("format"), merged)


def parse_logs(
    lines: DataFrame, default_year: int, formats: DataFrame | None = None
) -> DataFrame:
    """Detect each file's format, then parse all its non-blank lines with it.

    The formats are one small row per file (per session, if lines name no file). They are staged, so Spark knows
    their size when it chooses how to join them to the lines: a broadcast, or
    beyond the threshold a shuffle whose hot files adaptive execution splits.
    """
    if formats is None:
        formats = staged(detect_format(lines).select(*file_keys(lines), "format"), "formats")
    return parse_with_format(lines.join(formats, file_keys(lines)), default_year)


def validate_entries(entries: DataFrame) -> DataFrame:
    """Check rows against the entry schema; failures extend ``parse_error``."""
    required = ["id", "session_id", "line_num", "raw_line", "format"]
    checks = [
        F.when(F.col(name).isNull(), F.lit(f"Schema: {name} is required")) for name in required
    ]
    uuid = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"
    checks.append(F.when(~F.col("id").rlike(uuid), F.lit("Schema: id is not a uuid")))
    for name, kind in (("line_num", "bigint"), ("status_code", "int")):
        whole = F.col(name).try_cast(kind).cast("double") == F.col(name).try_cast("double")
        bad = F.col(name).isNotNull() & ~F.coalesce(whole, F.lit(False))
        checks.append(F.when(bad, F.lit(f"Schema: {name} is not an integer")))
    checks.append(
        F.when(
            F.col("ts").isNotNull() & F.col("ts").try_cast("timestamp").isNull(),
            F.lit("Schema: ts is not a date"),
        )
    )
    error = F.concat_ws("; ", F.col("parse_error"), *checks)
    return entries.withColumn("parse_error", non_empty(error))


def split_valid(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a recorded error."""
    return (
        entries.filter(F.col("parse_error").isNull()),
        entries.filter(F.col("parse_error").isNotNull()),
    )
