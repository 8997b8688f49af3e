"""Queries over the given tables against their SQL.

A selection by default; ``ALL_QUERIES=1`` runs every query.
"""

import os

import duckdb
import pytest

from spoorlog.plans import oracle, workload

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SOME = ["run_rules_union", "quota_audit", "parse_logs_mixed", "detect_format", "plain_text", "chunk_lines",
        "search_batch", "assemble_context", "validate_answers", "upsert_users", "stream_brute_force_exact", "stream_rule_counts", "stream_first_seen", "line_numbers",
        "ingest_tables", "entries_of_session", "ann_search", "parse_dates", "parse_rfc5424", "valid_entries", "own_rule",
        "top_sources_entries", "ask_documents"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 4) if isinstance(value, float) else value


def test_every_sql_has_its_query():
    assert set(oracle.ORACLE) <= set(workload.QUERIES)
    assert set(workload.QUERIES) - set(oracle.ORACLE) == set()


@pytest.mark.parametrize("name", sorted(workload.QUERIES) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, con, name):
    df = workload.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in oracle.ORACLE:
        assert got
        return
    cursor = con.execute(oracle.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    rows = cursor.fetchall()
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)
    assert got == wanted


def test_flagship(spark):
    df = workload.entry(spark, DATA)
    assert df.count() > 0 and "title" in df.columns
