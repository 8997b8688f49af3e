"""The registered queries on the smallest tables, and the SQL of those that have it."""

import os

import duckdb
import pytest

import corpus_pipeline
from spoorlog.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in queries.ORACLE:
        con = duckdb.connect()
        for table in ("documents", "conversations", "labels", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        cursor = con.execute(queries.ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, first = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
    assert 0 < docs.count()
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in first.select("doc_id").collect()}


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(r.lossless for r in rows)
