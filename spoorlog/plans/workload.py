"""The operators run over the given tables, one query per key."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorlog.functions import predicates as is_
from spoorlog.functions import text as X
from spoorlog.functions.dates import parse_epoch_or_date, rfc1123
from spoorlog.functions.vectors import format_vector_text, parse_vector_text
from spoorlog.operators import (
    chunking,
    context,
    formats,
    parsers,
    quota,
    reports,
    retrieval,
    rules,
    states,
    vector_index,
)
from spoorlog.plans import adapters as A
from spoorlog.plans.ask import ask
from spoorlog.plans.ingest import ingest
from spoorlog.session import prepare, shared_dir, staged
from spoorlog.sources import logs, tables
from spoorlog.streaming import keyed, streams

Query = Callable[[SparkSession, str], DataFrame]
DAY = A.DAY
SSH_LIMIT, WEB_LIMIT, SCAN_LIMIT = 2, 2, 6
YEAR = 2024
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# ---- rules ------------------------------------------------------------------

LIMITS = {
    "brute_force_ssh": partial(rules.rule_brute_force_ssh, window_ms=DAY, threshold=SSH_LIMIT),
    "brute_force_web": partial(rules.rule_brute_force_web, window_ms=DAY, threshold=WEB_LIMIT),
    "port_scan": partial(rules.rule_port_scan, window_ms=DAY, threshold=SCAN_LIMIT),
    "privilege_escalation": rules.rule_privilege_escalation,
    "off_hours_access": rules.rule_off_hours_access,
}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_entries(A.load(spark, sf_dir, "events"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings as a written table, made from a written table of what the rules look at."""
    return staged(rules.run_rules(looked_at(spark, sf_dir), LIMITS), "findings")


def looked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries written for the rules, without the ids and resources that none of them reads."""
    return staged(entries(spark, sf_dir).select(*rules.COLUMNS), "entries")


def flat(df: DataFrame) -> DataFrame:
    """Findings with their evidence in plain columns."""
    ev = lambda name: F.col(f"evidence.{name}")
    return df.select(
        "session_id", big("rule_ord"), big("seq"), "type", "severity", "title", "description", "source",
        F.coalesce(ev("ip"), ev("userName")).alias("who"),
        F.coalesce(ev("count"), ev("distinctPortsCount"), F.lit(0)).alias("n"),
        F.coalesce(F.array_join(ev("ports").cast("array<string>"), ","), F.lit("-")).alias("ports"),
        F.coalesce(F.array_join(ev("sampleLines"), "\n"), ev("rawLine")).alias("lines"),
        F.coalesce(ev("timeWindow"), ev("triggeredPattern"), ev("timestampUTC")).alias("detail"),
    )


def rule_query(name: str) -> Query:
    return lambda spark, sf_dir: flat(LIMITS[name](looked_at(spark, sf_dir)))


for _name, _key in {
    "brute_force_ssh": "brute_force", "brute_force_web": "web_brute_force", "port_scan": "port_scan",
    "privilege_escalation": "privilege_first_seen", "off_hours_access": "off_hours",
}.items():
    QUERIES[_key] = rule_query(_name)


@query
def run_rules_union(spark, sf_dir):
    return flat(findings(spark, sf_dir))


@query
def quota_audit(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "analyze").when(
        F.col("event_type") == "click", "upload").otherwise("report")
    requests = A.load(spark, sf_dir, "events").select(
        "event_id", "user_id", kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    quotas = {"analyze": (2, DAY), "upload": (1, DAY // 2), "report": (3, DAY)}
    return quota.quota_report(requests, quotas)


# ---- formats and parsers ----------------------------------------------------


def parsed(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", big("line_num"), F.unix_millis("ts").alias("ms"), "ip", "user_name", "action",
        "resource", big("status_code"), "format", "parse_error", F.md5("raw_line").alias("raw_md5"))


def parse_query(parse: Callable[[DataFrame], DataFrame], line: Callable[[], Column]) -> Query:
    def run(spark, sf_dir):
        lines = staged(A.rendered(A.load(spark, sf_dir, "events"), line()), "lines")
        return parsed(parse(lines)).drop("raw_md5")
    return run


QUERIES["parse_syslog"] = parse_query(lambda df: parsers.parse_syslog(df, YEAR), A.syslog_line)
QUERIES["parse_access"] = parse_query(parsers.parse_access_log, A.access_line)
QUERIES["parse_kv"] = parse_query(parsers.parse_kv, A.kv_line)
QUERIES["parse_audit_json"] = parse_query(parsers.parse_audit_json, A.audit_line)


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily logs written out, as raw logs are files before they are parsed."""
    return staged(A.daily_logs(A.load(spark, sf_dir, "events")), "lines")


@query
def parse_logs_mixed(spark, sf_dir):
    return parsed(parsers.parse_logs(daily_lines(spark, sf_dir), YEAR)).drop("raw_md5")


@query
def detect_format(spark, sf_dir):
    return formats.detect_format(A.daily_logs(A.load(spark, sf_dir, "events")))


@query
def detect_format_documents(spark, sf_dir):
    lines = A.document_lines(A.load(spark, sf_dir, "documents"))
    return formats.detect_format(lines).select("session_id", "generic_score", "format")


@query
def sniff_by_name(spark, sf_dir):
    """Event lines as first lines of files, some of them called .json."""
    df = A.named_heads(A.load(spark, sf_dir, "events"))
    return df.select("event_id", formats.sniff_by_name(F.col("name"), F.col("first")).alias("log_source"))


@query
def plain_text(spark, sf_dir):
    """Free text through the key=value parser, pairs included."""
    lines = A.document_lines(A.load(spark, sf_dir, "documents"))
    return parsed(parsers.parse_kv(lines)).drop("ms", "parse_error", "format")


@query
def syslog_errors(spark, sf_dir):
    """Lines that are no syslog keep their row, with the reason."""
    lines = A.document_lines(A.load(spark, sf_dir, "documents"))
    return reports.parse_quality(parsers.validate_entries(parsers.parse_syslog(lines, YEAR)))


@query
def extract_ipv4(spark, sf_dir):
    lines = A.document_lines(A.load(spark, sf_dir, "documents"))
    return lines.select(
        "session_id", big("line_num"), X.extract_ipv4(F.col("raw_line")).alias("ip")
    ).filter(F.col("ip").isNotNull())


@query
def dest_port(spark, sf_dir):
    """Also takes parts of clock times for ports, as the rule is defined."""
    lines = A.daily_logs(A.load(spark, sf_dir, "events"))
    return lines.select(
        "session_id", big("line_num"), X.extract_destination_port(F.col("raw_line")).alias("port")
    ).filter(F.col("port").isNotNull())


SPELLINGS = {
    2: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", 4: "yyyy/MM/dd HH:mm:ss", 5: "MMM d, yyyy HH:mm:ss", 6: "d MMMM yyyy HH:mm:ss",
    7: "MM/dd/yyyy hh:mm:ss a", 8: "EEE MMM dd yyyy HH:mm:ss 'GMT+0000 (Coordinated Universal Time)'",
    9: "d MMM yyyy HH:mm:ss '+0530'", 10: "MMMM d, yyyy HH:mm:ss 'UTC'", 11: "yyyy-M-d H:mm:ss",
}


@query
def parse_dates(spark, sf_dir):
    """Event times in a dozen spellings, read back."""
    ts = F.col("ts").cast("timestamp")
    turn = F.col("event_id") % 12
    text = F.when(turn == 0, F.unix_seconds(ts).cast("string")).when(turn == 1, F.unix_millis(ts).cast("string")).when(
        turn == 3, rfc1123(ts))
    for k, form in SPELLINGS.items():
        shifted = ts + F.expr("interval 330 minutes") if "+0530" in form else ts
        text = text.when(turn == k, F.date_format(shifted, form))
    return A.load(spark, sf_dir, "events").select(
        "event_id", F.unix_millis(parse_epoch_or_date(text)).alias("ms"))


# ---- files and tables -------------------------------------------------------


@query
def session_from_path(spark, sf_dir):
    """Events as uploads; purchases are not named like one."""
    name = F.when(F.col("event_type") == "purchase", F.concat(F.lit("cart-"), F.col("user_id").cast("string"))).otherwise(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"),
                 F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("_"), F.col("event_type"), F.lit("_1.log")))
    files = A.load(spark, sf_dir, "events").select("event_id", name.alias("file_name")).withColumn(
        "file_path", F.concat(F.lit("/in/"), F.col("file_name")))
    return logs.session_from_path(files).select(
        "event_id", "session_id", F.unix_millis("upload_ts").alias("ms"), "upload_name")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spoorlog/{name}-{uuid.uuid4().hex}"


@query
def line_numbers(spark, sf_dir):
    """Documents written as text files of 50 each, read back and numbered."""
    path = scratch(spark, "files")
    docs = A.load(spark, sf_dir, "documents").select(
        "doc_id", F.expr("doc_id div 50").alias("file"), "text")
    (docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text")
     .write.partitionBy("file").text(path))
    lines = logs.with_line_numbers(logs.read_logs(spark, path))
    return logs.non_blank(lines).select(
        F.regexp_extract("file_path", r"/file=(\d+)/", 1).cast("bigint").alias("file"),
        big("line_num"), F.md5("raw_line").alias("raw_md5"))


@query
def entries_table(spark, sf_dir):
    path = scratch(spark, "entries")
    tables.write_entries(entries(spark, sf_dir), path)
    return parsed(tables.read_entries(spark, path))


@query
def entries_of_session(spark, sf_dir):
    """One session's entries out of the table, in order, and after it was replaced by its web requests."""
    path = scratch(spark, "entries")
    stored = entries(spark, sf_dir)
    tables.write_entries(stored, path)
    again = stored.filter((F.col("session_id") == "host-1") & (F.col("action") == "GET"))
    tables.write_entries(again, path)
    tables.write_entries(again.limit(0), path, spark.createDataFrame([("host-2",)], "session_id string"))
    left = tables.read_entries(spark, path).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    one = tables.read_entries(spark, path, "host-1").withColumn("n", F.lit(0).cast("bigint"))
    return one.select("session_id", "line_num", "n").unionByName(
        left.select("session_id", F.lit(0).cast("bigint").alias("line_num"), "n"))


def kept_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Entries per session of a table of which one session was rewritten and one emptied."""
    rows = tables.read_entries(spark, path)
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line_num").alias("lines"))


@query
def compact_table(spark, sf_dir):
    """A table with replaced sessions, rewritten as one batch; what is read, and how many batches are left."""
    path = scratch(spark, "entries")
    stored = entries(spark, sf_dir)
    tables.write_entries(stored, path)
    tables.write_entries(stored.filter((F.col("session_id") == "host-1") & (F.col("action") == "GET")), path)
    tables.write_entries(stored.limit(0), path, spark.createDataFrame([("host-2",)], "session_id string"))
    tables.compact(spark, path)
    dropped = tables.expire(spark, path)
    return kept_sessions(spark, path).withColumns({
        "batches": F.lit(len(tables.commits(spark, path))).cast("bigint"), "dropped": F.lit(dropped).cast("bigint")})


@query
def delete_sessions(spark, sf_dir):
    """Sessions taken out of all tables by one call, then one of them uploaded again."""
    target = scratch(spark, "job")
    stored = entries(spark, sf_dir)
    tables.write_entries(stored, f"{target}/entries")
    tables.write_findings(findings(spark, sf_dir), f"{target}/findings")
    tables.delete_sessions(spark.createDataFrame([("host-1",), ("host-2",), ("nobody",)], "session_id string"), target)
    tables.write_entries(stored.filter(F.col("session_id") == "host-2"), f"{target}/entries")
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("held", F.lit(name))
    return count(tables.read_entries(spark, f"{target}/entries"), "entries").unionByName(
        count(tables.read_findings(spark, f"{target}/findings"), "findings"))


@query
def ingest_states(spark, sf_dir):
    """Sessions of the ingest with their owner and state, after a run and after one that failed."""
    base, events = scratch(spark, "ingest"), A.load(spark, sf_dir, "events")
    lines = A.daily_logs(events).select(F.col("session_id").alias("day"), "line_num", "raw_line")
    (lines.repartition("day").sortWithinPartitions("day", "line_num").select("day", F.col("raw_line").alias("value"))
     .write.partitionBy("day").text(f"{base}/in"))
    out = ingest(spark, f"{base}/in", f"{base}/tables", YEAR, embed=lambda df: chunking.embed_constant(df, 4), owner="ann")
    rows = tables.sessions_of_user(tables.read_sessions_table(spark, f"{base}/tables/sessions"), "ann")
    done = staged(rows.groupBy("status").agg(F.count(F.lit(1)).alias("sessions"), F.sum("log_count").alias("lines")), "done")

    def broken(df):
        raise RuntimeError("no embedding service")

    try:
        ingest(spark, f"{base}/in", f"{base}/tables", YEAR, embed=broken, owner="ann")
    except RuntimeError:
        pass
    lost = tables.read_sessions_table(spark, f"{base}/tables/sessions").groupBy("status").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("log_count").alias("lines"))
    total = out.agg(F.lit("observed").alias("status"), F.sum("failed").alias("sessions"), F.sum("parsed").alias("lines"))
    return done.unionByName(lost).unionByName(total)


@query
def ingest_tables(spark, sf_dir):
    """Daily logs as files, through the whole ingest, twice; per session what the tables hold."""
    day = F.regexp_extract("session_id", r"/day=([^/]+)/", 1)
    return ingested(spark, sf_dir).select(day.alias("day"), "log_source", "log_count", "entries", "failed", "chunk_count")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "ingest")
    events = A.load(spark, sf_dir, "events")
    lines = A.daily_logs(events).select(F.col("session_id").alias("day"), "line_num", "raw_line")
    (lines.repartition("day").sortWithinPartitions("day", "line_num").select("day", F.col("raw_line").alias("value"))
     .write.partitionBy("day").text(f"{base}/in"))
    for _ in range(2):
        ingest(spark, f"{base}/in", f"{base}/tables", YEAR)
    stored = tables.read_entries(spark, f"{base}/tables/entries")
    per_session = stored.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count("parse_error").alias("failed"))
    chunks = tables.read_chunks(spark, f"{base}/tables/chunks").groupBy("session_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = tables.read_sessions_table(spark, f"{base}/tables/sessions").withColumnRenamed("id", "session_id")
    return rows.join(per_session, "session_id").join(chunks, "session_id")


@query
def lookups(spark, sf_dir):
    """A session by id, a user's sessions newest first, a user by address."""
    sessions = A.session_table(entries(spark, sf_dir))
    by_id = tables.session_by_id(sessions, "host-2").select(F.lit("id").alias("kind"), F.col("id").alias("value"))
    newest = tables.sessions_of_user(sessions, "operator").select(F.lit("user").alias("kind"), F.col("id").alias("value"))
    users = A.load(spark, sf_dir, "customer").select(F.col("c_name").alias("email"), F.col("c_custkey").cast("string").alias("id"))
    one = tables.user_by_email(users, "Customer#000000007").select(F.lit("email").alias("kind"), F.col("id").alias("value"))
    return by_id.unionByName(newest).unionByName(one)


@query
def valid_entries(spark, sf_dir):
    """Events as lines of both syslog kinds and lines that are none: rows parsed and rows set aside."""
    lines = staged(A.rendered(A.load(spark, sf_dir, "events"), A.mixed_syslog_line()), "lines")
    good, bad = parsers.split_valid(parsers.validate_entries(staged(parsers.parse_syslog(lines, YEAR), "parsed")))
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name), F.sum("line_num").alias(f"{name}_lines"))
    return count(good, "valid").join(count(bad, "invalid"), "session_id")


@query
def parse_rfc5424(spark, sf_dir):
    lines = A.rendered(A.load(spark, sf_dir, "events"), A.rfc5424_line())
    return parsed(parsers.parse_syslog(lines, YEAR)).drop("raw_md5")


@query
def own_rule(spark, sf_dir):
    """A rule of one's own, registered beside the built-in ones: carts of the night before."""
    rules.register_rule("night_carts", lambda e: rules.rule_privilege_escalation(e, ["reboot"]))
    try:
        out = rules.run_rules(staged(entries(spark, sf_dir), "entries"))
    finally:
        rules.unregister_rule("night_carts")
    found = out.filter(F.col("evidence.triggeredPattern") == "reboot")
    return found.select("session_id", "seq", "title")


@query
def bursts(spark, sf_dir):
    """The window rules at their own five minutes, one minute and limits, over events packed into bursts."""
    known = A.burst_entries(A.load(spark, sf_dir, "events"))
    out = rules.run_rules(staged(known, "entries"), {k: rules.BUILT_IN[k] for k in ("brute_force_ssh", "port_scan")})
    return flat(out).select("session_id", "type", "seq", "who", "n", "description", "detail")


@query
def findings_stored(spark, sf_dir):
    path = scratch(spark, "findings")
    tables.write_findings(findings(spark, sf_dir), path)
    return flat(tables.read_findings(spark, path))


@query
def vector_text(spark, sf_dir):
    vectors = A.load(spark, sf_dir, "embeddings")
    back = parse_vector_text(format_vector_text(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda a, x: a + x)
    return vectors.select("vec_id", F.size(back).cast("bigint").alias("n"), F.round(total, 3).alias("total"))


@query
def incident_reports(spark, sf_dir):
    out = tables.incident_report(
        findings(spark, sf_dir), F.col("session_id"), "Mon, 01 Jan 2024 00:00:00 GMT", part_size=200)
    at = lambda path: F.get_json_object("report", path)
    return out.select(
        "session_id", "part", F.json_array_length(at("$.findings")).cast("bigint").alias("n"),
        at("$.incidentId").alias("incident"), at("$.findings[0].title").alias("first_title"),
        at("$.findings[0].ip").alias("first_ip"), at("$.findings[1].description").alias("second_description"))


# ---- chunks and retrieval ---------------------------------------------------


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_lines(A.document_entries(A.load(spark, sf_dir, "documents")), 20)


@query
def chunk_lines(spark, sf_dir):
    return document_chunks(spark, sf_dir).select(
        "session_id", big("chunk_index"), big("line_start"), big("line_end"),
        F.md5("chunk_text").alias("text_md5"))


@query
def hit_lines(spark, sf_dir):
    lines = context.explode_hit_lines(document_chunks(spark, sf_dir))
    return lines.select("session_id", big("chunk_index"), big("line_num"), F.md5("line").alias("line_md5"))


def letters(texts: list[str]) -> list[list[float]]:
    """An embedding of one's own: counts of four letters."""
    return [[float(t.count(c)) for c in "aeio"] for t in texts]


@query
def embed_chunks_own(spark, sf_dir):
    vectors = chunking.embed_chunks(document_chunks(spark, sf_dir), letters)
    at = lambda i: F.col("embedding")[i].cast("bigint")
    return vectors.select("session_id", big("chunk_index"), at(0).alias("a"), at(1).alias("e"), at(2).alias("i"), at(3).alias("o"))


@query
def chunks_table(spark, sf_dir):
    """Chunks written with their vectors as text, and one session's read back in order."""
    path = scratch(spark, "chunks")
    tables.write_chunks(vector_chunks(spark, sf_dir), path, as_text=True)
    one = tables.read_chunks(spark, path, "label-3", as_text=True)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return one.select("session_id", big("chunk_index"), F.size("embedding").cast("bigint").alias("width"), F.round(total, 3).alias("total"))


@query
def embed_chunks(spark, sf_dir):
    """Hashed embeddings of every chunk; the length of each vector is 1."""
    vectors = chunking.embed_hashed(document_chunks(spark, sf_dir))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select(
        "session_id", big("chunk_index"), F.size("embedding").cast("bigint").alias("width"),
        F.round(norm, 3).alias("norm"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.embedding_chunks(A.load(spark, sf_dir, "embeddings"))


@query
def attach_embeddings(spark, sf_dir):
    """Chunks joined to vectors computed elsewhere."""
    chunks = vector_chunks(spark, sf_dir)
    joined = chunking.attach_embeddings(chunks.drop("embedding"), chunks)
    return joined.select("session_id", big("chunk_index"), "chunk_text", F.size("embedding").cast("bigint").alias("width"),
                         F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("session_id"),
        F.col("vec_id").alias("query_id"), "embedding")


def scored(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "query_id", big("rank"), big("chunk_index"), big("line_start"), big("line_end"),
        F.round("similarity", 4).alias("similarity"))


@query
def semantic_search(spark, sf_dir):
    first = A.load(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()  # the caller's query vector
    hits = retrieval.semantic_search(vector_chunks(spark, sf_dir), [float(x) for x in first[0]], 10)
    return hits.select(
        "session_id", big("chunk_index"), "chunk_text", big("line_start"), big("line_end"),
        F.round("similarity", 4).alias("similarity"))


@query
def search_batch(spark, sf_dir):
    return scored(retrieval.search_batch(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 10))


@query
def ann_search(spark, sf_dir):
    """The approximate search as it comes: whether it finds nine in ten of the exact top ten and scores under two fifths exactly."""
    asked, chunks = vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir)
    path = scratch(spark, "index")
    vector_index.build(chunks, path)
    found = staged(vector_index.candidates(spark, path, asked), "candidates")
    quality = retrieval.recall(vector_index.ranked(found, asked, chunks), retrieval.search_batch(asked, chunks, 10))
    share = vector_index.scored_share(found, asked, chunks).withColumnRenamed("session_id", "of")
    stored = spark.read.parquet(f"{path}/lists").groupBy("session_id").agg(F.count(F.lit(1)).alias("listed")).withColumnRenamed("session_id", "at")
    both = quality.join(share, F.col("session_id") == F.col("of")).join(stored, F.col("session_id") == F.col("at"))
    return both.select(
        "session_id", "wanted", "pairs", "listed", (F.col("recall") >= 0.9).alias("enough"), (F.col("share") <= 0.4).alias("few"))


@query
def ann_hits(spark, sf_dir):
    """The nearest chunk of every query by the trained index, a vector being its own nearest."""
    hits = retrieval.ann_search(vector_chunks(spark, sf_dir), vector_queries(spark, sf_dir))
    return scored(hits.filter(F.col("rank") == 1))


@query
def ann_search_all_cells(spark, sf_dir):
    """With a probe into every cell the approximate search is exact."""
    return scored(retrieval.ann_search(
        vector_chunks(spark, sf_dir), vector_queries(spark, sf_dir), 10, bits=3, probes=8))


def ranked_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every chunk of a source's documents as a hit of that source's question."""
    docs = A.load(spark, sf_dir, "documents")
    asked = docs.select(F.col("source").alias("query_id")).distinct().withColumn(
        "question", F.concat(F.lit("What happened in "), F.col("query_id"), F.lit("?")))
    nobody = A.load(spark, sf_dir, "region").select(
        F.col("r_name").alias("query_id"), F.lit("Anything?").alias("question"))
    owner = docs.select(F.col("doc_id").cast("string").alias("session_id"), F.col("source").alias("query_id"))
    hits = document_chunks(spark, sf_dir).join(owner, "session_id").withColumn(
        "similarity", 1 / (F.col("session_id").cast("double") + 1))
    return hits, asked.unionByName(nobody)


@query
def assemble_context(spark, sf_dir):
    hits, asked = ranked_hits(spark, sf_dir)
    out = context.assemble_context(hits, asked)
    return out.select("query_id", F.length("context").cast("bigint").alias("chars"), F.md5("context").alias("context_md5"))


@query
def build_prompts(spark, sf_dir):
    hits, asked = ranked_hits(spark, sf_dir)
    out = context.build_prompts(context.assemble_context(hits, asked, max_tokens=500))
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"))


@query
def ask_documents(spark, sf_dir):
    """User turns asked of the documents: embed, search, context, prompt."""
    pieces = chunking.embed_hashed(document_chunks(spark, sf_dir), size=256)
    chunks = staged(
        pieces.withColumn("source", F.pmod(F.col("session_id").cast("bigint"), F.lit(4)))
        .select(F.concat(F.lit("host-"), F.col("source").cast("string")).alias("session_id"),
                (F.col("session_id").cast("bigint") * 1000 + F.col("chunk_index")).alias("chunk_index"),
                "chunk_text", "line_start", "line_end", "embedding"), "chunks", free=True, codec="zstd")
    questions = A.questions(A.load(spark, sf_dir, "conversations"))
    embed = lambda df, text: chunking.embed_hashed(df, text, 256)
    out = ask(questions, chunks, 5, embed=embed)
    mark = "Question / Security Inquiry:\n"
    return out.select(
        "query_id", "session_id", F.md5(F.substring_index("prompt", mark, -1)).alias("question_md5"))


@query
def validate_answers(spark, sf_dir):
    answers = A.written_answers(A.load(spark, sf_dir, "conversations"))
    return context.validate_answers(answers).select(
        "conv_id", "turn", "error", F.col("answer.severity").alias("severity"),
        F.md5("answer.summary").alias("summary_md5"))


@query
def qa_history(spark, sf_dir):
    path = scratch(spark, "qa")
    answers = A.written_answers(A.load(spark, sf_dir, "conversations"))
    rows = context.archived_answers(
        context.validate_answers(answers).withColumn("created_at", F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn"))))
    tables.write_qa(rows, path)
    stored = tables.read_qa(spark, path)
    return context.explode_answer_findings(stored).select(
        "session_id", F.md5("question").alias("question_md5"), F.md5("summary").alias("summary_md5"),
        "severity", big("finding_pos"), "finding")


# ---- reports ----------------------------------------------------------------


@query
def severity_matrix(spark, sf_dir):
    return reports.severity_matrix(findings(spark, sf_dir))


@query
def severity_counts(spark, sf_dir):
    return reports.severity_counts(findings(spark, sf_dir))


@query
def hourly_histogram(spark, sf_dir):
    return reports.hourly_histogram(entries(spark, sf_dir))


@query
def top_sources(spark, sf_dir):
    return reports.top_sources(findings(spark, sf_dir), entries(spark, sf_dir)).withColumn("rank", big("rank"))


@query
def top_sources_entries(spark, sf_dir):
    """Logins found at odd hours on two hosts only; the entries fill in for the others."""
    known = entries(spark, sf_dir)
    some = findings(spark, sf_dir).filter((F.col("type") == "off_hours_access") & F.col("session_id").isin("host-0", "host-3"))
    return reports.top_sources(some, known).withColumn("rank", big("rank"))


@query
def timeline(spark, sf_dir):
    return reports.incident_timeline(entries(spark, sf_dir)).withColumn("rank", big("rank"))


@query
def ioc_summary(spark, sf_dir):
    return reports.ioc_summary(findings(spark, sf_dir), include_scan_ports=True)


@query
def parse_quality(spark, sf_dir):
    lines = A.daily_logs(A.load(spark, sf_dir, "events"))
    forced = lines.withColumn("format", F.when(F.col("session_id") < "day-2024-01-16", "apache").otherwise("syslog"))
    return reports.parse_quality(parsers.parse_with_format(forced, YEAR))


@query
def filter_findings(spark, sf_dir):
    known = findings(spark, sf_dir)
    out = reports.filter_findings(known, "medium", "SUDO").unionByName(reports.filter_findings(known, "all", "from 10.0.0.1"))
    return out.select("session_id", big("seq"), "type", "title")


@query
def findings_table(spark, sf_dir):
    return reports.findings_table(findings(spark, sf_dir)).withColumns({"rule_ord": big("rule_ord"), "seq": big("seq")})


@query
def evidence_lines(spark, sf_dir):
    out = reports.finding_evidence_lines(findings(spark, sf_dir))
    return out.select("session_id", big("rule_ord"), big("seq"), "title", big("line_pos"), "line")


def all_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events, and one per region without any rows."""
    idle = A.load(spark, sf_dir, "region").select(
        F.col("r_name").alias("id"), F.lit("idle").alias("name"), F.lit("pending").alias("status"),
        F.col("r_regionkey").cast("int").alias("log_count"))
    return A.session_table(entries(spark, sf_dir)).unionByName(idle, allowMissingColumns=True)


@query
def session_dashboard(spark, sf_dir):
    qa = A.exchanges(A.load(spark, sf_dir, "conversations"))
    out = reports.session_dashboard(
        all_sessions(spark, sf_dir), entries(spark, sf_dir), findings(spark, sf_dir), qa)
    return out.withColumn("log_count", big("log_count"))


@query
def total_events(spark, sf_dir):
    return reports.total_events(all_sessions(spark, sf_dir), entries(spark, sf_dir))


# ---- upserts and references -------------------------------------------------


@query
def upsert_users(spark, sf_dir):
    time = lambda n: F.timestamp_seconds(F.col(n))
    base = A.load(spark, sf_dir, "customer").select(
        F.concat(F.lit("id-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("email"), F.col("c_mktsegment").alias("name"),
        F.lit("base.png").alias("image"), time("c_custkey").alias("created_at"))
    changed = A.load(spark, sf_dir, "orders").select(
        F.format_string("Customer#%09d", "o_custkey").alias("email"),
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("image"),
        F.col("o_orderkey").alias("version"), time("o_orderkey").alias("created_at"))
    new = A.load(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("email"), F.lit("supplier").alias("name"), F.lit("").alias("image"),
        F.col("s_suppkey").alias("version"), time("s_suppkey").alias("created_at"))
    out = states.upsert_by_key(base, changed.unionByName(new))
    return out.select("email", "name", "image", F.unix_seconds("created_at").alias("created"),
                      F.startswith(F.col("id"), F.lit("id-")).alias("kept"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (F.when(kind == "error", "failed").when(kind == "purchase", "completed")
              .when(kind == "signup", "pending").otherwise("processing"))
    return A.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), status.alias("status"),
        F.when(kind == "purchase", F.col("event_id")).alias("log_count"),
        F.col("ts").cast("timestamp").alias("updated_at"))


@query
def latest_state(spark, sf_dir):
    sessions = A.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("status"),
        F.col("c_nationkey").cast("bigint").alias("log_count"), F.timestamp_seconds(F.lit(0)).alias("updated_at"))
    out = states.latest_session_state(sessions, status_log(spark, sf_dir))
    return out.select("id", "status", "log_count", F.unix_millis("updated_at").alias("ms"))


@query
def unknown_updates(spark, sf_dir):
    sessions = A.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    out = states.unknown_updates(sessions, status_log(spark, sf_dir))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("updates"))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sessions = A.load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return A.document_entries(A.load(spark, sf_dir, "documents")), sessions


@query
def valid_sessions(spark, sf_dir):
    kept = states.keep_valid_sessions(*labelled(spark, sf_dir))
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"))


@query
def orphans(spark, sf_dir):
    lost = states.orphans(*labelled(spark, sf_dir))
    return lost.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"))


# ---- streams ----------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = A.load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def streamed(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    return streams.run_to_end(df, scratch(spark, name), scratch(spark, name + "-state"), mode)


def replayed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    known = A.event_entries(event_stream(spark, sf_dir))
    last = {"format": "syslog", "action": "auth_failure", "ip": "0.0.0.0"}
    return streams.replay(known, build, scratch(spark, name), scratch(spark, name + "-state"), last)


@query
def stream_parse(spark, sf_dir):
    lines = A.rendered(event_stream(spark, sf_dir), A.access_line()).withColumn("format", F.lit("apache"))
    return parsed(streamed(streams.stream_parse(lines, YEAR), "stream-parse")).drop("raw_md5")


@query
def stream_rule_counts(spark, sf_dir):
    counts = lambda e: streams.stream_rule_counts(e, is_.is_ssh_failure(), 1, "1 day", "6 hours", "1 hour")
    return replayed(spark, sf_dir, counts, "stream-counts").select(
        "session_id", "ip", F.unix_millis("start").alias("start"), "count")


@query
def stream_brute_force_exact(spark, sf_dir):
    return replayed(
        spark, sf_dir, lambda e: streams.stream_brute_force_exact(e, is_.is_ssh_failure(), SSH_LIMIT, DAY, "1 hour"), "stream-exact")


@query
def stream_first_seen(spark, sf_dir):
    entries = A.event_entries(event_stream(spark, sf_dir))
    written = streamed(streams.stream_first_seen(entries), "stream-first", "update")
    return streams.first_seen(written).select("session_id", "user", "pattern", F.unix_millis("ts").alias("ms"), "line_num")


@query
def stream_off_hours(spark, sf_dir):
    entries = A.event_entries(event_stream(spark, sf_dir))
    return flat(streamed(streams.stream_off_hours(entries), "stream-off-hours"))


@query
def stream_alerts(spark, sf_dir):
    """The row at which each address first exceeds, as the stream tells it at once."""
    rows = replayed(
        spark, sf_dir, lambda e: keyed.stream_windows(e, is_.is_ssh_failure(), SSH_LIMIT, DAY, "1 hour"), "stream-alerts")
    first = rows.filter(F.col("kind") == "alert").groupBy("session_id", "ip").agg(F.min(F.struct("anchor", "value")).alias("first"))
    return first.select("session_id", "ip", "first.anchor", "first.value")


@query
def stream_first_seen_closed(spark, sf_dir):
    """First privilege patterns as final rows, from state that ends behind the watermark."""
    known = A.event_entries(event_stream(spark, sf_dir))
    last = {"format": "syslog", "session_id": "end", "raw_line": "sudo"}
    rows = streams.replay(known, keyed.stream_first_seen_closed, scratch(spark, "stream-closed"), scratch(spark, "stream-closed-state"), last)
    return rows.select("session_id", "user", "pattern", "ms", "line_num")


@query
def stream_entries_table(spark, sf_dir):
    """A stream committed into the entries table, and read back as the jobs read it."""
    path, state = scratch(spark, "entries"), scratch(spark, "entries-state")
    known = A.event_entries(event_stream(spark, sf_dir))
    for _ in range(2):
        streams.stream_to_job_tables(known, path, state).awaitTermination()
    return parsed(tables.read_entries(spark, path))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: mixed raw logs, formats detected, parsed, all rules applied."""
    stored = staged(parsers.parse_logs(daily_lines(prepare(spark), sf_dir), YEAR), "entries")
    return flat(rules.run_rules(stored, LIMITS))
