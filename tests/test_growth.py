"""What must not grow with the tables: plans, batches, rows between stages."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorlog import session
from spoorlog.operators import chunking, quota, retrieval, rules, sliding, vector_index
from spoorlog.plans import workload

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@given
def test_valid_entries_reads_parsed_rows(spark):
    """Both sides of the split read one written table; neither repeats the parser."""
    files = workload.valid_entries(spark, DATA).inputFiles()
    assert files and all("/parsed-" in f for f in files)


@given
def test_rules_have_what_they_look_at_written(spark, monkeypatch):
    """F11, F18-F21: ids and resources, which no rule reads, are neither made nor written for the findings."""
    written = {}

    def kept(df, name):
        written[name] = df
        return df

    monkeypatch.setattr(workload, "staged", kept)
    workload.findings(spark, DATA)
    assert set(written["entries"].columns) == set(rules.COLUMNS) and "findings" in written
    assert "md5(" not in written["entries"]._jdf.queryExecution().optimizedPlan().toString()


def chunk_rows(spark, vectors, session="s"):
    rows = [(session, i, i, i + 1, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "session_id string, chunk_index bigint, line_start bigint, line_end bigint, embedding array<float>")


def test_searches_get_each_vector_once_and_keep_k(spark):
    """What reaches a scoring task are blocks, never pairs of blocks, and it emits k rows a query, not k a block."""
    rng = np.random.default_rng(4)
    chunks = chunk_rows(spark, rng.normal(size=(900, 8))).coalesce(1)
    asked = chunks.selectExpr("session_id", "chunk_index AS query_id", "embedding")
    hits = retrieval._top_per_query(chunks, asked, ["session_id"], 5, block_rows=32, per_task=300)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInPandas" in plan
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append(r.chunk_index)
    x = np.array([r.embedding for r in chunks.orderBy("chunk_index").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert all(sorted(got[q]) == sorted(best[q]) for q in range(900))


def test_candidates_are_bounded_per_query(spark, tmp_path):
    """however many cells a query looks into, no more candidates of it leave a task than the index wants."""
    rng = np.random.default_rng(5)
    chunks = chunk_rows(spark, rng.normal(size=(1500, 8)))
    vector_index.build(chunks, str(tmp_path))
    depth = vector_index.load_models(spark, str(tmp_path))[8].depth
    found = vector_index.candidates(spark, str(tmp_path), chunks.selectExpr("session_id", "chunk_index AS query_id", "embedding"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert found.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= np.ceil(10 * depth)


def test_nearest_in_a_tight_group_is_oneself(spark):
    """codes of near copies rank by distance; by inner product a copy with a longer code came before the vector itself."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32)
    near = centre / np.linalg.norm(centre) + 0.02 * rng.normal(size=(400, 32))
    chunks = chunk_rows(spark, np.concatenate([near, rng.normal(size=(2600, 32))]))
    asked = chunks.selectExpr("session_id", "chunk_index AS query_id", "embedding")
    hits = retrieval.ann_search(chunks, asked).filter("rank = 1")
    assert hits.filter("query_id <> chunk_index").count() == 0 and hits.count() == 3000


@pytest.mark.parametrize("crowd", [0, 100_000])
def test_quota_in_pieces_and_whole(spark, monkeypatch, crowd):
    """F8: only crowded buckets are cut into pieces, which cost shuffles of their own; both ways give the same."""
    monkeypatch.setattr(sliding, "CROWD", crowd)
    rng = np.random.default_rng(8)
    rows = [(int(u), "k", int(t)) for u, t in zip(rng.integers(0, 4, 600), rng.integers(0, 9_000_000, 600))]
    df = spark.createDataFrame(rows, "user_id bigint, kind string, ms bigint")
    width = 2_000_000
    audit = quota.quota_audit(df, 20, width)
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert ("piece" in plan) == (crowd == 0)
    got = sorted((r.user_id, r.ms, r.in_window, r.retry_after) for r in audit.collect())
    wanted = []
    for u, _, t in rows:
        inside = [s for v, _, s in rows if v == u and t - width <= s <= t]
        if len(inside) > 20:
            wanted.append((u, t, len(inside), max(0, -(-(min(inside) + width - t) // 1000))))
    assert got == sorted(wanted) and got


@pytest.mark.parametrize("crowd", [0, 100_000])
def test_distinct_windows_in_pieces_and_whole(spark, monkeypatch, crowd):
    """the port scan sorts whole buckets where no address is crowded."""
    monkeypatch.setattr(sliding, "CROWD", crowd)
    rng = np.random.default_rng(9)
    rows = [(f"10.0.0.{a}", int(t), int(p)) for a, t, p in zip(rng.integers(0, 3, 300), rng.integers(1, 9_000_000, 300), rng.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "ip string, ms bigint, port bigint")
    width = 2_000_000
    pieces = sliding.crowded(df, ["ip"], width)
    assert pieces == (crowd == 0)
    got = {r.ip: (r.value, r.anchor) for r in sliding.sliding_window_max(df, ["ip"], width, 3, "port", pieces=pieces).collect()}
    count = lambda ip, t: len({p for a, s, p in rows if a == ip and t <= s <= t + width})
    wanted = {ip: max((count(ip, t), -t) for a, t, _ in rows if a == ip) for ip in {r[0] for r in rows}}
    assert got == {ip: (n, -t) for ip, (n, t) in wanted.items()}


def shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    """the shuffle of a table written with ``free`` goes with the write, and the setting is as before."""
    before = spark.conf.get(session.FREE_SHUFFLES)
    known = shuffle_files(spark)
    df = session.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sums", free=True)
    assert sorted((r.k, r.n) for r in df.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert not shuffle_files(spark) - known
    assert spark.conf.get(session.FREE_SHUFFLES) == before


def test_lines_are_dealt_once_before_they_are_cut(spark):
    """only whole lines are shuffled, by segment; a line never once for each of its chunks, nor a chunk's text."""
    lines = spark.range(1, 301).selectExpr("'s' AS session_id", "cast(id AS int) AS line_num", "concat('line ', id) AS raw_line")
    plan = chunking.chunk_lines(lines, 20)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("chunk_index" in x or "chunk_text" in x for x in dealt)


@pytest.mark.parametrize("size, overlap", [(20, 15), (7, 3), (5, 0), (60, 20)])
def test_chunks_over_blocks_and_segments_equal_loop(spark, monkeypatch, size, overlap):
    """chunks inside a block, over two blocks and over several segments, of files with gaps and of several lengths."""
    monkeypatch.setattr(chunking, "SEGMENT_LINES", 50)
    monkeypatch.setattr(chunking, "BLOCK_LINES", 16)
    files = {("a", "x"): range(1, 400, 3), ("a", "y"): range(1, 5), ("a", "z"): range(1, 240), ("b", "x"): [*range(1, 30), *range(180, 260)], ("c", "x"): range(1, 21)}
    rows = [(s, f, n, None if n == 9 else f"{s}{f} {n}") for (s, f), at in files.items() for n in at]
    got = chunking.chunk_lines(spark.createDataFrame(rows, "session_id string, file_name string, line_num int, raw_line string").repartition(5), size, overlap)
    wanted, step = [], max(size - overlap, 1)
    for s in "abc":
        index = 0
        for f in sorted(f for t, f in files if t == s):
            at = list(files[s, f])
            for lo in range(0, max(len(at) - size, 0) + step, step):
                cut = at[lo : lo + size]
                wanted.append((s, f, index, cut[0], cut[-1], "\n".join(f"{s}{f} {n}" for n in cut if n != 9)))
                index += 1
                if lo + size >= len(at):
                    break
    assert sorted((r.session_id, r.file_name, r.chunk_index, r.line_start, r.line_end, r.chunk_text) for r in got.collect()) == sorted(wanted)


def test_many_queries_meet_the_chunks_in_rounds(spark):
    """a shuffle never holds a key's chunks more often than a fixed number, however many parts its queries have."""
    rng = np.random.default_rng(6)
    big = chunk_rows(spark, rng.normal(size=(900, 8))).coalesce(1)
    small = chunk_rows(spark, rng.normal(size=(40, 8)), "t").coalesce(1)
    chunks = big.unionByName(small)
    asked = chunks.selectExpr("session_id", "concat(session_id, chunk_index) AS query_id", "embedding")
    found = retrieval._top_per_query(chunks, asked, ["session_id"], 5, block_rows=32, per_task=100)
    assert found.inputFiles() and all("/best-" in f for f in found.inputFiles())
    at_once = retrieval._top_per_query(chunks, asked, ["session_id"], 5, block_rows=32, per_task=1000)
    assert "FlatMapCoGroupsInArrow" in at_once._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted((r.session_id, r.query_id, r["rank"], r.chunk_index, round(r.similarity, 9)) for r in df.collect())
    assert len(plain(found)) == 940 * 5 and plain(found) == plain(at_once)


def test_texts_of_no_hit_are_left_out_before_the_shuffle(spark):
    """texts are told from those of the hits before they move; every hit gets its own."""
    chunks = spark.range(3000).selectExpr("concat('s', id % 3) AS session_id", "id AS chunk_index", "concat('text ', id) AS chunk_text")
    hits = spark.createDataFrame([("s0", 3, "q"), ("s0", 3, "r"), ("s1", 4, "q"), ("s1", 3, "q")], "session_id string, chunk_index bigint, query_id string")
    found = retrieval.with_chunk_text(hits, chunks)
    assert "might_contain" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.chunk_text) for r in found.collect()) == [("q", "text 3"), ("q", "text 4"), ("r", "text 3")]
    assert chunks.filter(retrieval._maybe_in(["session_id", "chunk_index"], hits)).count() < 300
    assert retrieval.with_chunk_text(hits.limit(0), chunks).count() == 0
