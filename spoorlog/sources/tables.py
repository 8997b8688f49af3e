"""Tables the jobs write and read: entries, chunks, findings, answers, reports."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorlog import schemas
from spoorlog.functions.vectors import format_vector_text, parse_vector_text
from spoorlog.operators.positions import with_positions
from spoorlog.session import staged


BUCKETS = 64


def bucket_of(session_id: Column) -> Column:
    """The folder a session's rows lie in."""
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def _folder(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


class Commit(NamedTuple):
    """A batch that is part of a table: whether it hides rows of earlier ones, or stands for all of them."""

    batch: str
    seq: int
    hides: bool
    whole: bool


COMMIT = "batch string, seq bigint, hides boolean, whole boolean"


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The batches a reader sees, oldest first; one small row each, kept few by :func:`compact`."""
    found = sorted((Commit(*r) for r in spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()), key=lambda c: c.seq)
    start = max((c.seq for c in found if c.whole), default=None)
    return found if start is None else [c for c in found if c.seq >= start]


def _known(spark: SparkSession, path: str) -> list[Commit]:
    """Like :func:`commits`; none of a table that is not there yet."""
    folder = _folder(spark, f"{path}/commits")
    return commits(spark, path) if folder.getFileSystem(_hadoop(spark)).exists(folder) else []


def _parts(spark: SparkSession, path: str, kind: str, schema: str | None, batches: list[str]) -> DataFrame:
    """The folders of some batches; others, also of jobs that died, are not listed."""
    reader = spark.read.option("basePath", f"{path}/{kind}")
    return (reader.schema(schema) if schema else reader).parquet(*[f"{path}/{kind}/batch={b}" for b in batches])


def _hidden(spark: SparkSession, path: str, seen: list[Commit]) -> DataFrame | None:
    """session_id, batch: rows of earlier batches that a later one replaced or deleted; None if there are none."""
    hiding = [c.batch for c in seen if c.hides]
    if not hiding:
        return None
    return _parts(spark, path, "superseded", "session_id string, hidden string, batch string", hiding).select("session_id", F.col("hidden").alias("batch"))


def _sessions_of(spark: SparkSession, path: str, seen: list[Commit]) -> DataFrame:
    """session_id, batch: which sessions the batches cover, without what is hidden."""
    rows = _parts(spark, path, "manifest", "session_id string, batch string", [c.batch for c in seen])
    hidden = _hidden(spark, path, seen)
    return rows if hidden is None else rows.join(hidden, ["session_id", "batch"], "left_anti")


def _commit(spark: SparkSession, path: str, batch: str, covered: DataFrame | None, known: list[Commit], whole: bool = False) -> None:
    """The last step of a write. Batches before it that hold ``covered`` sessions are hidden for these."""
    hides = False
    if covered is not None and known:
        old = _sessions_of(spark, path, known).join(covered, "session_id", "left_semi").select("session_id", F.col("batch").alias("hidden"))
        old.coalesce(8).write.mode("overwrite").parquet(f"{path}/superseded/batch={batch}")
        hides = not _parts(spark, path, "superseded", "session_id string, hidden string, batch string", [batch]).isEmpty()
    row = Commit(batch, 1 + max((c.seq for c in known), default=0), hides, whole)
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _write_batch(
    df: DataFrame, path: str, covered: DataFrame | None = None, slice_of: Column | None = None,
    replace: bool = True, batch: str | None = None,
) -> str:
    """Add the rows of ``df`` as a new batch, and let it replace the ``covered`` sessions.

    Rows lie in folders by batch and bucket of the session, so the number of folders
    does not depend on the number of sessions. A commit, written last, makes the
    batch part of the table; a job that dies before leaves the table as it was.
    Which sessions a batch holds is in its manifest. Of those that earlier batches
    hold too, pairs of session and batch are written as superseded, and readers
    leave these out; a table without rewritten sessions has none and is read
    without a join. A covered session without rows in ``df`` becomes empty. Without
    ``covered`` these are the sessions of ``df``; with ``replace`` off nothing is
    hidden and the rows add to their sessions. A batch whose name is committed
    already changes nothing, so a repeated write is harmless. Writes of the same
    session must not run at the same time.

    Parsed entries still lie as they were read and are written in place. Tables
    that come out of a shuffle have every bucket in every task; ``slice_of``
    gathers them by bucket and slice first, which keeps the files few and still
    spreads a large session over many tasks.
    """
    spark = df.sparkSession
    batch = batch or f"b-{uuid.uuid4().hex}"
    known = _known(spark, path)
    if batch in {c.batch for c in known}:
        return batch
    rows = df.withColumn("bucket", bucket_of(F.col("session_id")))
    if slice_of is not None:
        rows = rows.repartition("bucket", slice_of)
    rows.sortWithinPartitions("bucket", "session_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch}")
    sessions = (df if covered is None else covered).select(F.col("session_id").cast("string").alias("session_id")).distinct()
    sessions.coalesce(8).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    written = _parts(spark, path, "manifest", "session_id string, batch string", [batch]).select("session_id")
    _commit(spark, path, batch, written if replace else None, known)
    return batch


def _session(spark: SparkSession, path: str, schema: str, session_id: str | None, batch: str | None = None) -> DataFrame:
    """The present rows of one session, or of all; with a ``batch`` the rows of that write alone."""
    if batch is not None:
        return _parts(spark, path, "data", schema + ", batch string, bucket int", [batch]).drop("batch", "bucket")
    seen = commits(spark, path)
    rows = _parts(spark, path, "data", schema + ", batch string, bucket int", [c.batch for c in seen])
    hidden = _hidden(spark, path, seen)
    if session_id is not None:
        rows = rows.filter((F.col("session_id") == session_id) & (F.col("bucket") == bucket_of(F.lit(session_id))))
        hidden = None if hidden is None else hidden.filter(F.col("session_id") == session_id)
    if hidden is not None:
        rows = rows.join(hidden, ["session_id", "batch"], "left_anti")
    return rows.drop("batch", "bucket")


def compact(spark: SparkSession, path: str, slices: int = 16) -> None:
    """Rewrite the present rows as one batch that stands for all before it.

    Reads after it list one folder and join nothing. Readers that began before keep
    what they saw until :func:`expire` drops it. Nothing else may write meanwhile.
    """
    seen = commits(spark, path)
    batches = [c.batch for c in seen]
    stored = _parts(spark, path, "data", None, batches)
    hidden = _hidden(spark, path, seen)
    rows = stored if hidden is None else stored.join(hidden, ["session_id", "batch"], "left_anti")
    batch = f"c-{uuid.uuid4().hex}"
    place = F.pmod(F.xxhash64(*[c for c in stored.columns if c in ("line_num", "chunk_index", "seq", "id")]), F.lit(slices))
    (rows.drop("batch").repartition("bucket", place).sortWithinPartitions("bucket", "session_id")
     .write.partitionBy("bucket").parquet(f"{path}/data/batch={batch}"))
    _sessions_of(spark, path, seen).select("session_id").distinct().coalesce(8).write.parquet(f"{path}/manifest/batch={batch}")
    _commit(spark, path, batch, None, seen, whole=True)


def expire(spark: SparkSession, path: str) -> int:
    """Drop the folders of batches that a compaction has made needless; returns how many."""
    keep = {c.batch for c in commits(spark, path)}
    every = [r.batch for r in spark.read.schema(COMMIT).parquet(f"{path}/commits").select("batch").distinct().collect()]
    gone = [b for b in every if b not in keep]
    for batch in gone:
        for kind in ("data", "manifest", "superseded"):
            folder = _folder(spark, f"{path}/{kind}/batch={batch}")
            folder.getFileSystem(_hadoop(spark)).delete(folder, True)
    return len(gone)


#: Everything that hangs on a session.
JOB_TABLES = ("entries", "chunks", "findings", "qa", "sessions")


def delete_sessions(sessions: DataFrame, target: str, names: tuple[str, ...] = JOB_TABLES) -> None:
    """Take the sessions (``session_id``) out of every table under ``target``.

    Each table gets a batch without rows that hides what it holds of them; a later
    upload of a session is seen again. Rows go from the disk with :func:`compact`
    and :func:`expire`. Tables that are not there are passed over. A run that dies
    between two tables is repeated whole; what is hidden already stays so.
    """
    spark = sessions.sparkSession
    gone = staged(sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct(), "deleted")
    for name in names:
        path = f"{target}/{name}"
        known = _known(spark, path)
        if known:
            stored = _parts(spark, path, "data", None, [c.batch for c in known])
            batch = f"d-{uuid.uuid4().hex}"
            stored.drop("batch").limit(0).write.partitionBy("bucket").parquet(f"{path}/data/batch={batch}")
            gone.limit(0).write.parquet(f"{path}/manifest/batch={batch}")
            _commit(spark, path, batch, gone, known)


def write_entries(entries: DataFrame, path: str, covered: DataFrame | None = None) -> str:
    """Returns the name of the batch written."""
    return _write_batch(schemas.conform(entries, schemas.LOG_ENTRIES), path, covered)


def add_entries(entries: DataFrame, path: str, batch: str) -> None:
    """Entries that add to their sessions; a ``batch`` that was added before changes nothing."""
    _write_batch(schemas.conform(entries, schemas.LOG_ENTRIES), path, replace=False, batch=batch)


def add_findings(findings: DataFrame, path: str, batch: str) -> None:
    """Findings that add to their sessions; a ``batch`` that was added before changes nothing."""
    stored = with_evidence_json(schemas.conform(findings, schemas.FINDINGS))
    _write_batch(stored, path, slice_of=F.floor(F.col("seq") / 1_000_000), replace=False, batch=batch)


def read_entries(spark: SparkSession, path: str, session_id: str | None = None, batch: str | None = None) -> DataFrame:
    """Entries, of one session in line order, of all unordered, or of one batch as it was written."""
    df = _session(spark, path, schemas.LOG_ENTRIES, session_id, batch)
    return df if session_id is None else df.orderBy("file_name", "line_num")


def write_chunks(chunks: DataFrame, path: str, as_text: bool = False, covered: DataFrame | None = None) -> None:
    """Chunks with ``array<float>`` embeddings, or ``[a,b,…]`` texts on request."""
    df = schemas.conform(chunks, schemas.CHUNKS)
    if as_text:
        df = df.withColumn("embedding", format_vector_text(F.col("embedding")))
    _write_batch(df, path, covered, F.floor(F.col("chunk_index") / 10_000))


def read_chunks(spark: SparkSession, path: str, session_id: str | None = None, as_text: bool = False) -> DataFrame:
    """Chunks, of one session in order or of all unordered; ``as_text`` reads vectors written as text."""
    stored = schemas.CHUNKS.replace("embedding array<float>", "embedding string") if as_text else schemas.CHUNKS
    df = _session(spark, path, stored, session_id)
    if as_text:
        df = df.withColumn("embedding", parse_vector_text(F.col("embedding")).cast("array<float>"))
    return df if session_id is None else df.orderBy("chunk_index")


def with_evidence_json(findings: DataFrame) -> DataFrame:
    """Evidence as JSON text without absent fields; no evidence stays NULL."""
    return findings.withColumns(
        {
            "evidence": F.to_json("evidence"),
            "source": F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("rule")),
        }
    )


def write_findings(findings: DataFrame, path: str, covered: DataFrame | None = None) -> None:
    stored = with_evidence_json(schemas.conform(findings, schemas.FINDINGS))
    _write_batch(stored, path, covered, F.floor(F.col("seq") / 1_000_000))


def read_findings(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    stored = schemas.FINDINGS.replace(schemas.EVIDENCE, "string")
    df = _session(spark, path, stored, session_id)
    df = df.withColumn("evidence", F.from_json("evidence", schemas.EVIDENCE))
    return df if session_id is None else df.orderBy("created_at", "rule_ord", "seq")


def write_qa(answers: DataFrame, path: str) -> None:
    df = schemas.conform(answers, schemas.QA_HISTORY)
    stored = df.withColumn("answer", F.to_json("answer"))
    _write_batch(stored, path, None, F.pmod(F.xxhash64("id"), F.lit(1024)))


def add_qa(answers: DataFrame, path: str) -> None:
    """Add answers to their sessions' archives; an answer already there, by id, is kept once."""
    fresh = schemas.conform(answers, schemas.QA_HISTORY)
    if not _known(answers.sparkSession, path):
        return write_qa(fresh.dropDuplicates(["id"]), path)
    stored = read_qa(answers.sparkSession, path)
    kept = stored.join(fresh.select("session_id").distinct(), "session_id", "left_semi").join(fresh.select("id"), "id", "left_anti")
    write_qa(staged(kept.unionByName(fresh.dropDuplicates(["id"])), "answers"), path)


def read_qa(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    df = _session(spark, path, schemas.QA_HISTORY.replace(schemas.ANSWER, "string"), session_id)
    df = df.withColumn("answer", F.from_json("answer", schemas.ANSWER))
    return df if session_id is None else df.orderBy("created_at")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Rows of :data:`schemas.SESSIONS`, keyed by ``id``."""
    df = schemas.conform(sessions, schemas.SESSIONS).withColumn("session_id", F.col("id"))
    _write_batch(df, path, None, F.lit(0))


def read_sessions_table(spark: SparkSession, path: str) -> DataFrame:
    return _session(spark, path, schemas.SESSIONS + ", session_id string", None).drop("session_id")


def report_lines(findings: DataFrame) -> DataFrame:
    """One row per finding of a briefing, numbered from 0 in rule order: what a briefing lists, at any size."""
    segment = F.struct("rule_ord", F.floor(F.col("seq") / 65_536).alias("reach"))
    placed = with_positions(findings, ["session_id"], segment, ["rule_ord", "seq", "id"])
    return placed.select(
        "session_id", "pos", "severity", "title", "description",
        F.coalesce(F.nullif(F.col("evidence.ip"), F.lit("")), F.lit("Unknown")).alias("ip"))


def incident_report(
    findings: DataFrame, target_asset: Column | str, analysis_date: str,
    summary: str | None = None, part_size: int | None = None,
) -> DataFrame:
    """A JSON briefing per session, its findings in rule order.

    With a ``part_size`` a session's briefing comes in documents of that many
    findings, numbered by ``part``; :func:`report_lines` has the same as rows.
    """
    asset = F.lit(target_asset) if isinstance(target_asset, str) else target_asset
    placed = report_lines(findings)
    line = F.struct("pos", "severity", "title", "description", "ip")
    part = F.lit(0).cast("bigint") if part_size is None else F.floor(F.col("pos") / part_size)
    grouped = placed.groupBy(
        "session_id", part.alias("part")
    ).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    listed = F.transform(
        "lines",
        lambda f: F.struct(
            f.severity.alias("severity"), f.title.alias("title"),
            f.description.alias("description"), f.ip.alias("ip"),
        ),
    )
    return grouped.select(
        "session_id",
        "part",
        F.to_json(
            F.struct(
                F.col("session_id").alias("incidentId"),
                asset.alias("targetAsset"),
                F.lit(analysis_date).alias("analysisDate"),
                listed.alias("findings"),
                F.lit(summary).cast("string").alias("timelineSummary"),
            )
        ).alias("report"),
    )


def session_by_id(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("id") == session_id)


def sessions_of_user(sessions: DataFrame, user_id: str) -> DataFrame:
    """Newest first."""
    return sessions.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "id")


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.col("email") == email)
