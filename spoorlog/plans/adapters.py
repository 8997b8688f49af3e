"""The given tables seen as logs: events as requests, documents as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorlog import schemas
from spoorlog.functions.text import stable_uuid
from spoorlog.session import prepare
from spoorlog.sources.logs import non_blank

DAY = 86_400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by_type(**texts: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, text in texts.items():
        out = F.when(F.col("event_type") == kind, text).otherwise(out)
    return out


def requests(events: DataFrame) -> DataFrame:
    """Events with the address, account and message they stand for.

    Errors are failed logins, signups successful ones, clicks and views web
    requests, purchases privileged commands.
    """
    user = F.col("user_id")
    df = events.select(
        (F.col("event_id") + 1).cast("bigint").alias("line_num"),
        _text("host-", user % 4).alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        _text("10.0.", F.expr("user_id div 256"), ".", user % 256).alias("ip"),
        _text("u", user).alias("user_name"),
    )
    k, login = F.col("k"), lambda word: _text(
        word, " password for ", F.col("user_name"), " from ", F.col("ip"), " port ", F.col("k"), " ssh2"
    )
    command = (
        F.when(k % 4 == 0, "sudo reboot")
        .when(k % 4 == 1, "su - root")
        .when(k % 4 == 2, "usermod -aG wheel")
        .otherwise("groupadd ops")
    )
    status = (
        F.when((F.col("event_type") == "click") & (k < 50), 401)
        .when((F.col("event_type") == "click") & (k < 80), 403)
        .otherwise(200)
    )
    return df.withColumns(
        {
            "message": _by_type(
                error=login("Failed"),
                signup=login("Accepted"),
                view=_text("GET /view?port=", k),
                click=_text("POST /click?port=", k),
                purchase=_text(command, " port=", k),
            ),
            "status_code": status,
        }
    )


def event_entries(events: DataFrame) -> DataFrame:
    """Events as parsed ``log_entries``."""
    df = requests(events).withColumns(
        {
            "id": stable_uuid(F.col("session_id"), F.col("line_num")),
            "action": _by_type(
                error=F.lit("auth_failure"), signup=F.lit("login"), view=F.lit("GET"),
                click=F.lit("POST"), purchase=F.lit("exec"),
            ),
            "resource": _text("/", F.col("event_type")),
            "raw_line": F.col("message"),
            "format": F.lit("syslog"),
        }
    )
    return schemas.conform(df, schemas.LOG_ENTRIES)


def syslog_line() -> Column:
    stamp = F.date_format("ts", "MMM d HH:mm:ss")
    return _text("<34>", stamp, " web-01 sshd[", F.col("line_num"), "]: ", F.col("message"))


def access_line() -> Column:
    who = F.when(F.col("event_type") == "view", "-").otherwise(F.col("user_name"))
    return _text(
        F.col("ip"), " - ", who, " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /',
        F.col("event_type"), "?k=", F.col("k"), ' HTTP/1.1" ', F.col("status_code"), ' 512 "-" "agent 1.0"',
    )


def kv_line() -> Column:
    return _text(
        "ts=", F.unix_millis("ts"), " src=", F.col("ip"), " USER=", F.col("user_name"),
        ' event="', F.col("event_type"), "\" path='/", F.col("event_type"), "' status=",
        F.col("status_code"), " k=", F.col("k"),
    )


def audit_line() -> Column:
    failed = F.when(F.col("event_type") == "error", "AccessDenied").when(
        F.col("event_type") == "click", "Throttled"
    )
    event = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("eventTime"),
        F.col("event_type").alias("eventName"),
        F.lit("shop.example.com").alias("eventSource"),
        F.col("ip").alias("sourceIPAddress"),
        F.struct(F.col("user_name").alias("userName")).alias("userIdentity"),
        failed.alias("errorCode"),
    )
    return _text(F.to_json(event), ",")


def rfc5424_line() -> Column:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    app = F.when(F.col("event_type") == "view", "-").otherwise("sshd")
    return _text("<34>1 ", stamp, " web-01 ", app, " ", F.col("line_num"), " ID [k v] ", F.col("message"), " exit=", F.col("k"))


def mixed_syslog_line() -> Column:
    """Both kinds of syslog, and every third line of neither."""
    turn = F.col("line_num") % 3
    return F.when(turn == 0, syslog_line()).when(turn == 1, rfc5424_line()).otherwise(_text("free text ", F.col("message")))


def named_heads(events: DataFrame) -> DataFrame:
    """Event lines in five formats as first lines of files."""
    lines = requests(events).withColumn("turn", F.col("line_num") % 5)
    first = F.when(F.col("turn") == 0, syslog_line()).when(F.col("turn") == 1, access_line()).when(
        F.col("turn") == 2, audit_line()).when(F.col("turn") == 3, _text("x sshd[", F.col("k"), "] ", F.col("user_name"))).otherwise(kv_line())
    name = F.when(F.col("line_num") % 7 == 0, "events.JSON").otherwise("events.log")
    return lines.select((F.col("line_num") - 1).alias("event_id"), first.alias("first"), name.alias("name"))


def burst_entries(events: DataFrame) -> DataFrame:
    """Entries of three addresses, each week squeezed into four minutes."""
    df = event_entries(events)
    day = F.date_trunc("week", F.col("ts"))
    near = (F.unix_millis("ts") - F.unix_millis(day)) / 2500
    address = F.concat(F.lit("10.9.9."), (F.col("line_num") % 3).cast("string"))
    return df.withColumn("ts", F.timestamp_millis((F.unix_millis(day) + F.floor(near)).cast("bigint"))).withColumn("ip", address)


def rendered(events: DataFrame, line: Column, session: Column | None = None) -> DataFrame:
    """Events written out as raw log lines."""
    df = requests(events)
    return df.select(
        (F.col("session_id") if session is None else session).alias("session_id"),
        "line_num",
        line.alias("raw_line"),
    )


def daily_logs(events: DataFrame) -> DataFrame:
    """One log per day, in a format that changes from day to day."""
    turn = F.dayofmonth("ts") % 4
    line = (
        F.when(turn == 0, syslog_line())
        .when(turn == 1, access_line())
        .when(turn == 2, kv_line())
        .otherwise(audit_line())
    )
    return rendered(events, line, _text("day-", F.date_format("ts", "yyyy-MM-dd")))


def document_lines(documents: DataFrame) -> DataFrame:
    """Documents as files of numbered lines, blank ones included."""
    return documents.select(
        F.col("doc_id").cast("string").alias("session_id"),
        F.posexplode(F.split("text", "\n")).alias("pos", "raw_line"),
    ).select("session_id", (F.col("pos") + 1).cast("bigint").alias("line_num"), "raw_line")


def document_entries(documents: DataFrame) -> DataFrame:
    return non_blank(document_lines(documents))


def embedding_chunks(embeddings: DataFrame) -> DataFrame:
    """Vectors as chunks, their label as session."""
    at = F.col("vec_id")
    return embeddings.select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("session_id"),
        at.alias("chunk_index"),
        F.concat(F.lit("chunk "), at.cast("string")).alias("chunk_text"),
        (at * 10 + 1).alias("line_start"),
        (at * 10 + 10).alias("line_end"),
        "embedding",
    )


def exchanges(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    asked = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answered = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(answered, ["conv_id", "turn"]).withColumn(
        "session_id", _text("host-", F.col("conv_id") % 4)
    )


def questions(conversations: DataFrame) -> DataFrame:
    """Every user turn as a question, answered or not."""
    return conversations.filter(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        _text("host-", F.col("conv_id") % 4).alias("session_id"), F.col("text").alias("question"))


def written_answers(conversations: DataFrame) -> DataFrame:
    """Exchanges whose reply is wrapped as an answer, some of them broken."""
    iocs = "named_struct('ips', array('10.0.0.1'), 'ports', array(22, 8080), 'userAgents', array(), 'hashes', array())"
    finding = (
        "named_struct('title', concat('finding ', turn), 'severity', 'low', 'affectedIps', array('10.0.0.1'),"
        f" 'affectedUsers', array(), 'evidence', array(reply), 'iocs', {iocs})"
    )
    whole = (
        "to_json(named_struct('summary', reply, 'severity', {severity}, 'threatCategories', array('access'),"
        " 'findings', array({finding}){rest}))"
    )
    advice = ", 'recommendations', array('rotate keys')"
    good = whole.format(severity="'medium'", finding=finding, rest=advice)
    turn = F.col("conv_id") % 5
    text = (
        F.when(turn == 0, F.expr(whole.format(severity="'medium'", finding=finding, rest="")))
        .when(turn == 1, F.expr(whole.format(severity="'urgent'", finding=finding, rest=advice)))
        .when(turn == 2, F.expr(f"substring({good}, 1, length({good}) - 1)"))
        .when(turn == 3, F.expr(whole.format(
            severity="'medium'", finding=finding.replace("array(22, 8080)", "array('22')"), rest=advice)))
        .otherwise(F.expr(good))
    )
    return exchanges(conversations).withColumn("answer_text", text)


def session_table(entries: DataFrame) -> DataFrame:
    """A ``sessions`` row for every session in ``entries``."""
    grouped = entries.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("log_count"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )
    return grouped.select(
        F.col("session_id").alias("id"), F.lit("operator").alias("user_id"),
        F.concat(F.lit("logs of "), F.col("session_id")).alias("name"),
        F.lit("syslog").alias("log_source"), F.lit("completed").alias("status"),
        "log_count", "created_at", "updated_at",
    )
