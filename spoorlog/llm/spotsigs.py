"""Document fingerprints by spot signatures.

A signature starts at a common word (an anchor) and is the anchor followed by a
chain of the next content words. The set of a text's signatures, as sorted
32-bit numbers in hexadecimal, is its fingerprint. Common words sit all through
prose and rarely in menus, so the set follows the prose.

Words are runs of letters and digits in lower case. Chains that the text's end
cuts short are kept as long as they have one content word. A text without
signatures but with words has one signature over all its words; a text without
words has the empty fingerprint. The likeness of two fingerprints is the Jaccard
of their sets, 1 for two empty ones. Null text is empty; rows are independent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.llm.words import Block, blocks, documents, folded, look, mix, span_hashes, word_table
from spoorlog.session import staged

#: Common words of the languages at hand; signatures start at them.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it not of on or that the their they this to was were which with you "
    "au avec ce dans de des du elle en est et il la le les mais ou par pas pour qui que sur un une "
    "aber als auch auf das dem den der die ein eine es für ich im ist mit nicht sich sie sind und von wir zu "
    "al como con del el es la las lo los más no para pero por se sin su sus una y"
).split()
CHAIN = 3


def word_ids(words: list[str]) -> np.ndarray:
    block = Block(words)
    return np.sort(span_hashes(folded(block.codes), block.text_at[:-1], block.text_at[1:] - 1))


_anchor_ids: list[np.ndarray] = []


def signatures(block: Block, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted set of each text's signatures, as 32-bit numbers."""
    if not _anchor_ids:
        _anchor_ids.append(np.unique(word_ids(ANCHORS)))
    known = _anchor_ids[0]
    codes = folded(block.codes)
    starts, ends = block.words(look(word_table(), codes))
    word = span_hashes(codes, starts, ends)
    text = block.text_of(starts)
    near = known[np.minimum(np.searchsorted(known, word), len(known) - 1)]
    anchor = near == word
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    at = np.searchsorted(content, spots)  # the first content word behind each anchor
    sig = word[spots]
    some = np.zeros(len(spots), bool)
    for step in range(chain):
        k = at + step
        i = content[np.minimum(k, max(len(content) - 1, 0))] if len(content) else np.zeros(len(spots), np.int64)
        there = (k < len(content)) & (text[i] == text[spots]) if len(content) else np.zeros(len(spots), bool)
        sig = np.where(there, mix(sig * np.uint64(31) + word[i]) if len(word) else sig, sig)
        some |= there
    spots, sig = spots[some], sig[some]
    cell = np.unique((text[spots].astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
    cut = np.searchsorted(cell >> np.uint64(32), np.arange(block.n + 1, dtype=np.uint64))
    low = cell.astype(np.uint32)
    bound = np.searchsorted(text, np.arange(block.n + 1))
    whole = span_hashes(word, bound[:-1], bound[1:])
    return [
        low[a:b] if b > a else (whole[i : i + 1] >> np.uint64(32)).astype(np.uint32) if bound[i + 1] > bound[i] else low[:0]
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))
    ]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_sigs, fingerprint of each row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                sets = signatures(block)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(first, block.n), "n_sigs": [len(s) for s in sets], "fingerprint": [as_text(s) for s in sets]})

    return documents(df).mapInArrow(run, "doc_id bigint, n_sigs bigint, fingerprint string")


# ---- similar fingerprints ---------------------------------------------------


def length_class(size: int | np.ndarray, threshold: float) -> np.ndarray:
    """Partition of a set length: two lengths that may reach the threshold are at most one class apart."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(threshold) + 1e-9).astype(np.int64)


def similar(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with Jaccard of ``threshold`` or more.

    Returns (fingerprint_a, fingerprint_b, likeness), ordered inside a pair. Equal
    fingerprints are one class before any comparison, so copies make no pairs.
    Sets are partitioned by length: only lengths that can reach the threshold
    meet. Inside a partition a set is found by its rarest signatures, as many as
    any similar set must share one of; pairs are compared once, and only if the
    lengths and the places of their first shared signature still allow the threshold.
    """
    spark = prints.sparkSession

    def unpack(batches):
        for batch in batches:
            names, sets = batch.column(0), [from_text(t) for t in batch.column(0).to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            rows = np.repeat(np.arange(len(sets)), size)
            yield pa.RecordBatch.from_pydict({
                "fp": names.take(pa.array(rows)), "size": size[rows],
                "sig": np.concatenate([*sets, np.zeros(0, np.uint32)]).astype(np.int64)})

    unique = prints.select(F.col("fingerprint").alias("fp")).filter(F.col("fp") != "").distinct()
    key = F.xxhash64("fp")
    sets = staged(unique.mapInArrow(unpack, "fp string, size bigint, sig bigint").select(key.alias("id"), "size", "sig"), "spot-sets")
    often = sets.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = sets.join(often.filter("often > 1"), "sig").withColumn(
        "place", F.row_number().over(Window.partitionBy("id").orderBy("often", "sig")))
    # Signatures that only one set has can match nothing, but they do take up the allowance.
    shared = F.count("*").over(Window.partitionBy("id"))
    allowance = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1 - (F.col("size") - shared)
    prefix = ranked.withColumn("allowance", allowance).filter(F.col("place") <= F.col("allowance")).select("id", "size", "sig")
    step = -float(np.log(threshold))
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    own = prefix.withColumn("band", band)
    probe = own.select("id", "size", "sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    a, b = own.alias("a"), probe.alias("b")
    found = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.sig") == F.col("b.sig"))).filter(
        "a.id <> b.id and (a.size > b.size or a.size = b.size and a.id < b.id)").filter(
        F.col("b.size") >= F.col("a.size") * threshold - 1e-9).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    names = unique.select(key.alias("id"), "fp")
    pairs = found.join(names.select(F.col("id").alias("a"), F.col("fp").alias("fa")), "a").join(
        names.select(F.col("id").alias("b"), F.col("fp").alias("fb")), "b").select("fa", "fb")

    def compare(batches):
        for batch in batches:
            left, right = ([from_text(t) for t in batch.column(i).to_pylist()] for i in (0, 1))
            score = np.array([likeness(x, y) for x, y in zip(left, right, strict=True)], np.float64)
            keep = pa.array(score >= threshold - 1e-12)
            yield pa.RecordBatch.from_pydict({
                "fa": batch.column(0).filter(keep), "fb": batch.column(1).filter(keep), "likeness": pa.array(score).filter(keep)})

    return spark.createDataFrame([], "fingerprint_a string, fingerprint_b string, likeness double").union(
        pairs.mapInArrow(compare, "fa string, fb string, likeness double").select(
            F.least("fa", "fb"), F.greatest("fa", "fb"), "likeness"))


# ---- each document beside its neighbour -------------------------------------


def with_neighbours(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, in order of doc_id.

    The edited text has its last quarter replaced by as much of the next
    document's beginning; the next document is the next row by doc_id, then text
    (null ids first), and the first one after the last. Documents are dealt to
    ranges of ids; the first row of each range also goes, as a guest, to the end
    of the range before, so one shuffle of the texts serves and no task sees
    more than its range. Only the ranges' first ids reach the driver, as many as
    there are ranges.
    """
    spark = df.sparkSession
    rows = documents(df)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id").filter("doc_id is not null")
    ranged = ids.repartitionByRange(ranges or 4 * n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least"))
    bounds = sorted({r["least"] for r in ranged.collect()})  # at most n numbers
    if not rows.filter("doc_id is null").isEmpty():
        bounds = [None, *bounds]
    numbers = [b for b in bounds if b is not None]
    edges = F.array(*[F.lit(b).cast("bigint") for b in numbers]) if numbers else F.expr("cast(array() as array<bigint>)")
    low = 1 if None in bounds else 0
    # ids below the first bound do not exist; a null id has range 0
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))) + F.lit(low - 1))
    last = max(len(bounds) - 1, 0)
    is_first = F.array_contains(edges, F.coalesce(F.col("doc_id"), F.lit(-1).cast("bigint"))) & F.col("doc_id").isNotNull()
    if None in bounds:
        is_first = is_first | F.col("doc_id").isNull()
    spot = lambda bucket, guest: F.struct(bucket.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    dealt = rows.withColumn("bucket", place).withColumn(
        "spots", F.when(is_first, F.array(spot(F.col("bucket"), False), spot(before, True))).otherwise(F.array(spot(F.col("bucket"), False)))
    ).select("doc_id", "text", F.explode("spots").alias("spot")).select("doc_id", "text", "spot.bucket", "spot.guest")
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(
        _beside,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _beside(batches):
    """Rows in order; a row is done when the row behind it is there, a guest only serves as such."""
    waiting: tuple | None = None  # the row whose neighbour is still to come
    served = -1  # the bucket whose first guest has come
    for batch in batches:
        doc_ids, texts, buckets, guests = (batch.column(i).to_pylist() for i in range(4))
        sets = [s for _, block in blocks(texts) for s in signatures(block)]
        done, edited = [], []
        for row in zip(doc_ids, texts, buckets, guests, sets, strict=True):
            if waiting is not None and waiting[2] == row[2] and served != row[2]:
                done.append((waiting, row))
                q = len(waiting[1]) // 4
                edited.append(waiting[1][: len(waiting[1]) - q] + row[1][:q])
            if row[3]:
                waiting, served = None, row[2]
            else:
                waiting = row
        changed = [s for _, block in blocks(edited) for s in signatures(block)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([a[0] for a, _ in done], pa.int64()),
            "n_chars": pa.array([len(a[1]) for a, _ in done], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "fingerprint": pa.array([as_text(a[4]) for a, _ in done], pa.string()),
            "edited_fingerprint": pa.array([as_text(s) for s in changed], pa.string()),
            "near_edited": pa.array([likeness(a[4], s) for (a, _), s in zip(done, changed, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a[4], b[4]) for a, b in done], pa.float64()),
        })
