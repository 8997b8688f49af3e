"""Exact clustering against plain loops."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from spoorlog.llm import bitplanes as B

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k, rounds, seed=2):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min((away(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(col) // len(vs) for col in zip(*vs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    of = lambda j: sum(d for _, c, d in out if c == j)
    sha = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    return sorted(((i, j, d, of(j), sum(x[2] for x in out), sha(j)) for i, j, d in out), key=repr)


def got(df, k=40, rounds=5):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in B.cluster(df, k, rounds).collect()), key=repr)


def test_planes_hold_any_numbers():
    rng = np.random.default_rng(3)
    for top in (1, 2, 300, 1 << 27):
        a, b = rng.integers(-top, top, (7, 64)), rng.integers(-top, top, (5, 64))
        assert (B.from_planes(B.to_planes(a)) == a).all()
        assert (B.dots(B.to_planes(a), B.to_planes(b)) == a @ b.T).all()
        assert (B.norms(B.to_planes(a)) == (a * a).sum(1)).all()
    assert B.to_planes(np.zeros((0, 64), np.int64)).shape[0] == 0


def test_clusters_equal_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.7, 64).astype(np.float32)]) for i in range(90)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (200, [0.25] * 64), (201, [0.25] * 64), (202, [-3e4] * 64)]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [float("nan")] + [0.0] * 63),
           (305, [float("inf")] + [0.0] * 63), (306, [None] + [0.0] * 63)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(4)
    assert got(df, 9, 3) == plain(rows + bad, 9, 3)
    more = df.withColumns({"planes": F.lit("mine"), "cluster": F.lit("mine"), "distance": F.lit(1), "parts": F.lit(0)})
    assert got(more, 9, 3) == plain(rows + bad, 9, 3)


def test_hot_vector_and_few_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(400)] + [(1000 + i, [float(np.float32(i / 7))] * 64) for i in range(5)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows, 40, 5)
    assert got(spark.createDataFrame(rows[:3], SCHEMA)) == plain(rows[:3], 40, 5)
    assert got(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)) == []
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_components_stop_at_the_bound(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    out = {r.vec_id: r for r in B.cluster(spark.createDataFrame(rows, SCHEMA), 1, 1).collect()}
    assert len(out) == 3 and all(0 <= r.distance < 1 << 63 for r in out.values())
