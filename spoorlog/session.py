"""Session settings and small tables written between the stages of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the jobs rely on.

    All clock arithmetic is in UTC. Generated methods beyond 8000 bytes are never
    compiled by the JVM; with this limit Spark splits them instead, which the wide
    projections of the parsers need. Rank filters up to 5000 run before their
    exchange too; the context budget admits a little over 1400 hits. The number
    that sizes file splits is pinned, as it would else follow the cores at hand,
    and two scans of the same files could be cut differently. Of equal keys in a
    JSON object the last one counts.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5000")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local folder only for local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="spoorlog-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, free: bool = False, codec: str | None = None) -> DataFrame:
    """Write a small intermediate table and read it back.

    The table survives lost executors, is computed once however many branches
    read it, and carries its true size. Spark therefore broadcasts it only
    when that size is under ``spark.sql.autoBroadcastJoinThreshold`` and uses a
    shuffle join otherwise, so nothing that grows with the data is broadcast
    unseen. With ``free`` the shuffle files of the write go when it ends, not at
    some later collection of the driver's garbage. ``codec`` is Parquet's own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spoorlog/{name}-{uuid.uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, str(free or before == "true").lower())
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
