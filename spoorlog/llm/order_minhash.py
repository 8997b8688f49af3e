"""Near-duplicate documents by order MinHash.

A text is its words (runs without white space, lower case); its k-mers are runs
of words, each labelled with how often it has occurred before. A sketch takes the
two labelled k-mers with the smallest keyed hashes and keeps them in text order,
so it agrees for texts that are close in edits, not just in content. A few
sketches make a band key; texts that share a key are candidates. Some bands take
runs of five words, as shingles do, others runs of two, of which scattered edits
leave more whole; short texts also have bands of single words. Their numbers are
chosen so that a pair at the threshold, edited anywhere, shares a key with a
probability of about 0.95. A candidate
pair is linked if its word edit similarity, 1 - distance / longer length, is
0.8 or more, by alignment in a band as wide as that allows. Classes are the
connected components of links.

Texts that are equal character for character are one node before anything is
paired, whatever their number. Of the nodes with a key the least is the centre,
and all others are compared with it. Those it links are done with those that
are more than half their length away from it, as the distances of two texts to a
third bound their own; so a large group of near copies costs one comparison a
node and key. What lies between is compared with what the centre linked, and all
that the centre did not link are a smaller set with a centre of its own. After a
few such rounds the rest are compared pair by pair. Only pairs that could still
join two classes are compared, and none of those is left out.

Null text is empty, and empty texts are one class, as equal texts are. Texts
without words but not equal are classes of their own. A class is named by its
least doc_id (null if none has an id); repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.llm.components import components, grown, with_comp
from spoorlog.llm.words import blocks, documents, folded, mix, span_hashes
from spoorlog.session import staged

#: Words in a k-mer, bands of that kind, sketches in a band, and the most words of a text that has such bands (None: any).
KMERS = ((5, 16, 3, None), (2, 80, 2, None), (1, 48, 3, 24))
SIMILARITY = 0.8
LINKED, BETWEEN, FAR = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def node_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def keyed(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each of n hash functions, the second odd."""
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))
    return base[:n, None], base[n:, None] | np.uint64(1)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mers mixed with the number of equal ones before them."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if first.all():
        return mix(kmers)
    start = np.maximum.accumulate(np.where(first, np.arange(len(kmers)), 0))
    seen = np.empty(len(kmers), np.uint64)
    seen[order] = (np.arange(len(kmers)) - start).astype(np.uint64)
    return mix(kmers + seen * _ODD)


def sketches(kmers: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each hash function, a hash of its two least labelled k-mers in text order."""
    marks = labelled(kmers)
    n, count = len(marks), len(a)
    out = np.empty(count, np.uint64)
    step = max(1, (1 << 20) // n)
    for lo in range(0, count, step):
        value = (marks[None, :] ^ a[lo : lo + step]) * b[lo : lo + step]
        row = np.arange(len(value))
        one = value.argmin(1)
        if n > 1:
            value[row, one] = np.uint64(0xFFFFFFFFFFFFFFFF)
            two = value.argmin(1)
        else:
            two = one
        out[lo : lo + step] = mix(marks[np.minimum(one, two)] * np.uint64(31) + marks[np.maximum(one, two)])
    return out


def band_keys(texts: list[str], kmers: tuple[tuple[int, int, int, int | None], ...] = KMERS) -> Iterator[list[np.ndarray]]:
    """Band keys of each text, block by block; none for a text without words."""
    drawn = [keyed(bands * rows, seed=k) for k, bands, rows, _ in kmers]
    tags = [mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(k << 32)) for k, bands, _, _ in kmers]
    for _, block in blocks(texts):
        starts, ends = block.space_words()
        word = span_hashes(folded(block.codes), starts, ends)
        bound = np.searchsorted(starts, block.text_at)
        out = []
        for lo, hi in zip(bound[:-1], bound[1:], strict=True):
            keys = [np.zeros(0, np.int64)]
            for (k, bands, rows, most), (a, b), tag in zip(kmers, drawn, tags, strict=True):
                size = min(k, hi - lo)
                if not size or most is not None and hi - lo > most:
                    continue
                at = np.arange(hi - lo - size + 1)
                found = sketches(span_hashes(word[lo:hi], at, at + size), a, b).reshape(bands, rows)
                key = tag
                for r in range(rows):
                    key = mix(key * np.uint64(31) + found[:, r])
                keys.append(key.view(np.int64))
            out.append(np.concatenate(keys))
        yield out


def sketch(df: DataFrame, kmers: tuple[tuple[int, int, int, int | None], ...] = KMERS) -> DataFrame:
    """doc_id, node, keys (array of bigint) of every row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            first = 0
            for keys in band_keys(texts, kmers):
                cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(first, len(keys)), "node": batch.column(1).slice(first, len(keys)),
                    "keys": pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))})
                first += len(keys)

    rows_ = documents(df).select("doc_id", node_of(F.col("text")).alias("node"), "text")
    return rows_.mapInArrow(run, "doc_id bigint, node binary, keys array<bigint>")


# ---- alignment --------------------------------------------------------------


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Bit-parallel: one integer holds the vertical differences of a column inside
    the band of ``most`` diagonals on either side, and moves down a row with
    every column. Common beginnings and ends are taken off first.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not len(b):
        return len(a)
    most = min(most, len(a))
    rows = a.tolist()
    where: dict[int, int] = {}
    for i, x in enumerate(rows):
        where[x] = where.get(x, 0) | 1 << i
    # Bits of column j stand for rows j - most .. j + most of the longer sequence.
    width = 2 * most + 1
    full = (1 << width) - 1
    vp, vn = full ^ ((1 << most) - 1), 0  # above row 0 there is no difference
    distance, centre = 0, 1 << most
    for j, x in enumerate(b.tolist()):
        shift = j - most
        eq = where.get(x, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full ^ ((d0 | vp) & full))
        hn = d0 & vp
        if not d0 & centre:
            distance += 1  # along the diagonal through the centre of the band, where it never falls
            if distance - (len(a) - len(b)) > most:
                return most + 1
        moved = d0 >> 1
        vp = (hn | (full ^ ((moved | hp) & full))) & full
        vn = moved & hp
    # From row len(b) of the last column down to row len(a).
    for step in range(len(a) - len(b)):
        bit = 1 << (most + step)
        distance += bool(vp & bit) - bool(vn & bit)
    return distance if distance <= most else most + 1


def compared(a: np.ndarray, b: np.ndarray, least: float, floor: float) -> tuple[int, int]:
    """Whether two texts are LINKED (similarity ``least`` or more), FAR (below ``floor``) or BETWEEN, and their distance unless FAR."""
    longer = max(len(a), len(b))
    if not longer:
        return LINKED, 0
    most = int((1 - floor) * longer + 1e-9)
    distance = banded_distance(a, b, most)
    if distance > most:
        return FAR, -1
    return (LINKED if distance <= (1 - least) * longer + 1e-9 else BETWEEN), distance


# ---- links and classes ------------------------------------------------------


PARITY = 64  # numbers of 64 bits


def parities(word: np.ndarray) -> list[int]:
    """For 4096 classes of words labelled with their occurrence, whether their number is odd, as bits.

    The labelled words that one text has and another lacks, and those the other way round,
    are at least as many as the bits that differ, and they differ in number as the texts
    do in length. An edit makes up for one of each, so the larger of the two numbers,
    half the sum of bits and lengths' difference or more, bounds the distance. Labels tell
    the occurrences of a repeated word apart, so texts full of one line cancel only what
    they share of it, and not each second one of their own.
    """
    bits = PARITY.bit_length() + 5
    odd = np.bincount((labelled(word.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _word_rows(df: DataFrame) -> DataFrame:
    """node, its words as 32-bit numbers, how many, and their parities."""

    def run(batches):
        for batch in batches:
            first = 0
            for _, block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                starts, ends = block.space_words()
                word = (span_hashes(folded(block.codes), starts, ends) >> np.uint64(32)).astype(np.uint32)
                bound = np.searchsorted(starts, block.text_at)
                own = [word[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column(0).slice(first, block.n), "words": [w.tobytes() for w in own],
                    "n": pa.array([len(w) for w in own], pa.int32()),
                    "parity": pa.array([parities(w) for w in own], pa.list_(pa.int64()))})
                first += block.n

    return df.select("node", "text").mapInArrow(run, "node binary, words binary, n int, parity array<bigint>")


COMPARED = "a binary, b binary, kind int, distance int"


def _compared(pairs: DataFrame, words: DataFrame, least: float, floor: float) -> DataFrame:
    """Pairs (a, b) with how they compare."""

    def run(batches):
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint32) for x in batch.column(i).to_pylist()] for i in (2, 3))
            found = [compared(x, y, least, floor) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "a": batch.column(0), "b": batch.column(1), "kind": pa.array([k for k, _ in found], pa.int32()),
                "distance": pa.array([d for _, d in found], pa.int32())})

    side = lambda node, name: words.select(F.col("node").alias(node), F.col("words").alias(name))
    # The first text is the centre of many pairs; by the second, of which a node has one a key at most, the pairs are dealt out evenly.
    joined = pairs.select("a", "b").join(side("a", "wa"), "a").join(side("b", "wb"), "b")
    return joined.select("a", "b", "wa", "wb").mapInArrow(run, COMPARED)


def links(df: DataFrame, sketched: DataFrame, least: float = SIMILARITY, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between different texts, enough to connect every class; and the classes (node, comp)."""
    nodes = sketched.groupBy("node").agg(F.first("keys").alias("keys"))
    rows = nodes.select("node", F.explode("keys").alias("key"))
    crowd = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = staged(rows.join(crowd, "key").select("key", "node"), "omh-keys")
    members = shared.select("node").distinct()
    texts = documents(df).select(node_of(F.col("text")).alias("node"), "text").join(members, "node")
    each = texts.dropDuplicates(["node"])
    words = staged(_word_rows(each), "omh-words")
    # Below this no text the centre links can reach ``least``: 0.8 * (1 - floor) >= 2 * 0.2, see the lengths' bound.
    floor = 1 - 2 * (1 - least) / least
    known = df.sparkSession.createDataFrame([], COMPARED)
    left, comp = shared, None
    for _ in range(rounds):
        centres = left.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
        spokes = staged(left.join(centres, "key").filter("node <> centre"), "omh-spokes")
        pairs = spokes.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        fresh = _compared(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), words, least, floor)
        known = staged(known.union(fresh), "omh-known")
        ends = (F.col("centre") == F.col("a")) & (F.col("node") == F.col("b"))
        rated = staged(spokes.join(known, ends).select("key", "node", "kind", "distance"), "omh-rated")
        comp = components(_thinned(_linked(known))) if comp is None else grown(comp, _linked(known))
        between = rated.filter(F.col("kind") == BETWEEN)
        near = rated.filter(F.col("kind") == LINKED).join(between.select("key").distinct(), "key", "left_semi")
        # Two texts differ by at least the difference of their distances to the centre.
        reach = F.col("dx") - F.col("dy") <= (1 - least) * F.greatest("nx", "ny") + 1e-9
        beside = _meeting(_sides(between, comp, words, "x"), _sides(near, comp, words, "y"), reach, least)
        known = _extended(known, beside, words, least, floor)
        left = rated.filter(F.col("kind") != LINKED).select("key", "node")
    comp = grown(comp, _linked(known))
    x, y = (_sides(left.withColumn("distance", F.lit(0)), comp, words, v) for v in "xy")
    known = _extended(known, _meeting(x, y, F.expr("x < y"), least), words, least, floor)
    return _linked(known), grown(comp, _linked(known))


def _sides(rows: DataFrame, comp: DataFrame, words: DataFrame, v: str) -> DataFrame:
    """Nodes of keys under the names of one side of a pair: node, class, distance to the centre, number of words, parities, all its keys in ``rows``."""
    keyed_ = rows.withColumn("keys", F.collect_set("key").over(Window.partitionBy("node")))
    return with_comp(keyed_, comp, "node", "c").join(words.select("node", "n", "parity"), "node").select(
        "key", F.col("node").alias(v), F.col("c").alias(f"c{v}"), F.col("distance").alias(f"d{v}"),
        F.col("n").alias(f"n{v}"), F.col("parity").alias(f"p{v}"), F.col("keys").alias(f"k{v}"))


def _meeting(x: DataFrame, y: DataFrame, wanted: Column, least: float) -> DataFrame:
    """Pairs of different classes that share a key and whose bounds allow the similarity, each pair once.

    Near copies share many keys; a pair belongs to the least of them. What holds for
    a pair by one key's centre holds for it, so a pair ruled out there is ruled out.
    """
    lengths = F.abs(F.col("nx") - F.col("ny")) <= (1 - least) * F.greatest("nx", "ny") + 1e-9
    once = F.col("key") == F.array_min(F.array_intersect("kx", "ky"))
    return x.join(y, "key").filter(wanted & (F.col("cx") != F.col("cy")) & lengths & once & _fits(least))


def _fits(least: float) -> Column:
    """Whether the lower bound of two texts' distance by length and parities allows the similarity.

    Written as a loop: spelled out, it makes the join one method too long for the JVM to compile.
    """
    apart = F.zip_with("px", "py", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda s, n: s + n) + F.abs(F.col("nx") - F.col("ny")) <= 2 * ((1 - least) * F.greatest("nx", "ny") + 1e-9)


def _linked(known: DataFrame) -> DataFrame:
    return known.filter(F.col("kind") == LINKED).select("a", "b")


def _thinned(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same nodes.

    A node is mostly linked to many centres that are one class anyway. It keeps the
    link to the least of them, and the others are linked to that one instead, which
    is the same few links over and over.
    """
    least = links.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    return least.select(F.col("least").alias("a"), "b").union(least.select("least", "a")).filter("a <> b").distinct()


def _extended(known: DataFrame, pairs: DataFrame, words: DataFrame, least: float, floor: float) -> DataFrame:
    """``known`` and the comparisons of those pairs (x, y) that it does not have."""
    ordered = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    fresh = _compared(ordered.join(known.select("a", "b"), ["a", "b"], "left_anti"), words, least, floor)
    return staged(known.union(fresh), "omh-known")


def classes(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node, comp, class_id and class_size, one row per input row."""
    sketched = staged(sketch(df), "omh-sketches")
    _, comp = links(df, sketched, least)
    per_node = sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = with_comp(per_node, comp, "node", "comp")
    total = named.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    table = staged(named.join(total, "comp").select("node", "comp", "class_id", "class_size"), "omh-classes")
    return sketched.select("doc_id", "node").join(table, "node")


def keep_one(df: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, all columns, one of each class: the least doc_id's (a text without ids stays once too)."""
    table = classes(df, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("keep_id"), F.col("node").alias("keep_node")))
    kept = table.groupBy("comp").agg(first.alias("first")).select("first.keep_id", "first.keep_node")
    rows = df.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("of"), node_of(F.col("text")).alias("text_node"))
    mine = rows.join(kept, F.col("of").eqNullSafe(F.col("keep_id")) & (F.col("text_node") == F.col("keep_node")))
    return mine.dropDuplicates(["of", "text_node"]).select("row.*")
