"""Centroid clustering of integer vectors by bit planes and population counts.

A vector of 64 whole numbers in two's complement is kept as one unsigned 64-bit
word per bit plane: bit j of plane b is bit b of component j. The dot product of
two such vectors is the sum, over pairs of planes, of 2**(a+b) times the number
of bits set in both; the plane of the signs weighs negative. All of it is exact,
and so are distances, means and ties.

Vectors are packed once into a staged table of some eighty bytes a vector. Each
round reads it, and of a round only one row of sums per task and centroid is
shuffled. The driver sees ``k`` times 64 numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorlog.session import staged

WIDTH = 64
SCALE = 256
#: Components stop at 2**27 either way, so that every squared distance fits a long.
BITS = 28
CHUNK = 1024


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, parts: the vectors of 64 finite components as whole numbers floor(256 x)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    top = 1 << (BITS - 1)
    part = lambda v: F.greatest(F.lit(float(-top)), F.least(F.lit(float(top - 1)), F.floor(v * SCALE).cast("double"))).cast("int")
    kept = vectors.filter((F.size("embedding") == WIDTH) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, part).alias("parts"))


def to_planes(parts: np.ndarray) -> np.ndarray:
    """(n, 64) whole numbers as (n, planes) words; as few planes as hold them all."""
    low, high = (int(parts.min()), int(parts.max())) if parts.size else (0, 0)
    n_bits = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    out = np.empty((len(parts), n_bits), np.uint64)
    for b in range(n_bits):
        out[:, b] = np.packbits(((parts >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(n_bits: int) -> np.ndarray:
    """What a set bit of each plane adds; the last plane holds the signs."""
    out = np.int64(1) << np.arange(n_bits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The (n, 64) whole numbers again."""
    out = np.zeros((len(planes), WIDTH), np.int64)
    for b, weight in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits * weight
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product of every vector of ``a`` with every one of ``b``, both as planes.

    Pairs of planes with the same shift are counted together before the shift.
    """
    p, q = a.shape[1], b.shape[1]
    out = np.zeros((len(a), len(b)), np.int64)
    columns = [np.ascontiguousarray(b[:, j]) for j in range(q)]
    for shift in range(p + q - 1):
        for negative in (False, True):
            pairs = [(i, shift - i) for i in range(p) if 0 <= shift - i < q and ((i == p - 1) != (shift - i == q - 1)) == negative]
            if pairs:
                count = np.zeros(out.shape, np.int32)
                for i, j in pairs:
                    count += np.bitwise_count(a[:, i, None] & columns[j])
                part = count.astype(np.int64) << shift
                out += -part if negative else part
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Dot product of each vector with itself."""
    weight = weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for i, wi in enumerate(weight):
        for j in range(i, len(weight)):
            both = np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
            out += both * (wi * weight[j] * (1 if i == j else 2))
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and its squared distance."""
    own, best, far = norms(centroids), np.empty(len(planes), np.int64), np.empty(len(planes), np.int64)
    for lo in range(0, len(planes), CHUNK):
        cut = planes[lo : lo + CHUNK]
        distance = norms(cut)[:, None] - 2 * dots(cut, centroids) + own
        best[lo : lo + CHUNK] = at = np.argmin(distance, axis=1)
        far[lo : lo + CHUNK] = distance[np.arange(len(cut)), at]
    return best, far


def packed(parts: DataFrame) -> DataFrame:
    """vec_id, planes (bytes, eight per plane); a batch takes as many planes as its largest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                planes = to_planes(values.reshape(-1, WIDTH))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in planes], pa.binary())], ["vec_id", "planes"])

    return parts.mapInArrow(run, "vec_id bigint, planes binary")


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and planes of a batch's vectors, by number of planes."""
    raw = batch.column(batch.schema.get_field_index("planes")).to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), "<u8").reshape(len(at), -1)


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floor of the mean of their vectors; those without any stay."""
    k, planes_of = len(centroids), to_planes(np.array(centroids, np.int64))
    names = [f"s{j}" for j in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, planes in _by_width(batch):
                best, _ = nearest(planes, planes_of)
                order = np.argsort(best, kind="stable")
                present, starts = np.unique(best[order], return_index=True)
                sums[present] += np.add.reduceat(from_planes(planes)[order], starts, axis=0)
                counts += np.bincount(best, minlength=k)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(counts[seen]), *[pa.array(sums[seen, j]) for j in range(WIDTH)]], ["cluster", "n", *names])

    partial = table.select("planes").mapInArrow(run, "cluster int, n bigint, " + ", ".join(f"{s} bigint" for s in names))
    totals = partial.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)])
    out = [list(c) for c in centroids]
    for row in totals.collect():  # at most k rows
        out[row.cluster] = [int(row[s]) // int(row.n) for s in names]
    return out


def assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of every packed vector."""
    planes_of = to_planes(np.array(centroids, np.int64).reshape(-1, WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, planes in _by_width(batch):
                cluster[at], distance[at] = nearest(planes, planes_of)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.select("vec_id", "planes").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def first_centroids(parts: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the least hash of seed and id; of equal ids the lesser vector first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.parts) for r in parts.select(name.alias("name"), "parts").orderBy("name", "parts").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read. Kept
    are vectors of exactly 64 components, none null or not finite; each becomes
    floor(256 x), and what lies beyond 2**27 stops there. A null id counts as
    empty text in the hash that picks the first centroids; repeated rows are
    vectors of their own; equal distances go to the smaller number. With fewer
    than ``k`` vectors each is a first centroid; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    parts = whole_vectors(vectors)
    table = staged(packed(parts), "planes")
    centroids = first_centroids(parts, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(table, centroids)
    out = staged(assigned(table, centroids), "clusters")
    totals = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # at most k rows
    of = [(c, t, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in totals.items()]
    each = spark.createDataFrame(of, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(each, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
