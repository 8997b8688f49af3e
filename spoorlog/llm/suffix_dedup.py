"""Repeated passages by sparse suffix arrays.

A text is its words (runs without white space, lower case). A suffix is kept
only where the hash of its first six words is the least in some window of
``span`` such hashes; what a passage contains alone decides that, so equal
passages keep suffixes at equal places, at least one in any ``span`` places.
Suffixes are sorted by content and each is compared with its nearest neighbours
from another document, then the match is extended to the right and to the left.
Matches of ``least`` words or more are reported, joined into maximal passages.

Suffixes are sorted twice, by what follows and then what precedes, and the other
way round, so that a neighbour with the longest match on either side is next.
Most suffixes occur once; a count of the hash of their first ``head`` words
(``least`` - ``span`` + 1, which the first kept suffix of any reported passage
has in common) drops them before any context is carried. Sorting is by range, so
one passage in a third of all documents is spread over many tasks; the few rows
at the ranges' edges are compared once more.

Neighbours do not tell the lowest document that has a passage. Of the runs of
``least`` words around a suffix (a run that two documents have is around a suffix
both keep), those that a neighbour may have, but none was seen to have in a lower
document, are open; the lowest document's are among them. Where documents have
open runs with one head, a least over the hashes of the runs finds the lowest.

Repeats inside one document are not reported. Rows with the same doc_id count as
one document, and rows without an id as one document named null. Null and short
texts have no suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.llm.words import blocks, documents, folded, map_texts, mix, span_hashes
from spoorlog.session import staged

LEAST, SPAN, GRAM = 50, 24, 6
NO_ID = -(1 << 62)
EDGE = 16
OPEN = "head bigint, places array<int>, keys array<bigint>, offsets array<int>"
FOUND = "doc bigint, start bigint, end bigint, other bigint, other_start bigint, n bigint, lowest bigint"


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def kept_places(word: np.ndarray, span: int, gram: int = GRAM) -> np.ndarray:
    """Places of a text's words where suffixes are kept; in a run of one hash only a few."""
    n = len(word) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    hashes = span_hashes(word, at, at + gram)
    if n < span:
        chosen = hashes == hashes.min()
    else:
        least = window_least(hashes, span)
        padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
        chosen = ~window_least(~padded, span) == hashes  # the largest least of the windows around a place
    repeated = hashes[1:] == hashes[:-1]
    if repeated.any():  # in a run, the first and every few places counted from its end
        last = np.append(np.flatnonzero(~repeated), n - 1)
        left = last[np.searchsorted(last, at)] - at
        chosen[1:] &= ~repeated | (left[1:] % (span // 2) == 0)
    return np.flatnonzero(chosen)


def _texts(texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word hashes of each text, block by block, with the block's first text."""
    for first, block in blocks(texts):
        starts, ends = block.space_words()
        word = span_hashes(folded(block.codes), starts, ends)
        bound = np.searchsorted(starts, block.text_at)
        yield first, [word[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]


def suffixes(df: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """doc, place, head: kept suffixes with at least ``least - span + 1`` words, and the hash of that many."""
    head = least - span + 1

    def fn(batch: pa.RecordBatch, texts: list[str]) -> Iterator[dict]:
        docs = batch.column(batch.schema.get_field_index("doc")).to_numpy(zero_copy_only=False)
        for first, words in _texts(texts):
            doc, place, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, word in enumerate(words):
                at = kept_places(word, span)
                at = at[at <= len(word) - head]
                if len(at):
                    doc.append(np.full(len(at), docs[first + i]))
                    place.append(at)
                    hashed.append(span_hashes(word, at, at + head))
            yield {"doc": np.concatenate(doc), "place": np.concatenate(place).astype(np.int32),
                   "head": np.concatenate(hashed).view(np.int64)}

    return map_texts(_named(df), fn, "doc bigint, place int, head bigint")


def _named(df: DataFrame) -> DataFrame:
    return documents(df).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")


def _contexts(df: DataFrame, least: int, span: int) -> DataFrame:
    """Rows of (doc, text, places) to suffixes: head, the words behind it, the words before it (nearest first).

    Places of one document that are alike in all of this are one row, under the
    first of them, so text that repeats itself makes no long runs of equal suffixes.
    """
    head, reach = least - span + 1, span

    def run(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2).to_pylist()
            for first, words in _texts([t or "" for t in batch.column(1).to_pylist()]):
                out = {k: [] for k in ("doc", "place", "head", "after", "before", "places")}
                for i, word in enumerate(words):
                    at = np.unique(np.array(places[first + i], np.int64))
                    at = at[at <= len(word) - head]
                    short = (word >> np.uint64(32)).astype(">u4")
                    back = short[::-1]
                    n, alike = len(word), {}
                    for p, h in zip(at.tolist(), span_hashes(word, at, at + head).view(np.int64).tolist(), strict=True):
                        key = (h, short[p + head : p + head + reach].tobytes(), back[n - p : n - p + reach].tobytes())
                        alike.setdefault(key, []).append(p)
                    for (h, after, before), own in alike.items():
                        for k, v in (("doc", int(docs[first + i])), ("place", own[0]), ("head", h), ("after", after), ("before", before), ("places", own)):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array(out["doc"], pa.int64()), "place": pa.array(out["place"], pa.int32()),
                    "head": pa.array(out["head"], pa.int64()), "after": pa.array(out["after"], pa.binary()),
                    "before": pa.array(out["before"], pa.binary()),
                    "places": pa.array(out["places"], pa.list_(pa.int32()))})

    return df.mapInArrow(run, "doc bigint, place int, head bigint, after binary, before binary, places array<int>")


def _matrix(values: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    raw = b"".join(v.ljust(4 * reach, b"\0") for v in values)
    return np.frombuffer(raw, ">u4").reshape(len(values), reach), sizes


def _common(x: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that rows i and j of a matrix have in common from the beginning."""
    words, sizes = x
    differ = words[i] != words[j]
    return np.minimum(np.where(differ.any(1), differ.argmax(1), words.shape[1]), np.minimum(sizes[i], sizes[j]))


def matched(doc: np.ndarray, place: np.ndarray, head: np.ndarray, after: list[bytes], before: list[bytes],
            places: list[list[int]], least: int, span: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Matches of sorted suffixes with the nearest neighbours from another document, a row per place that has one.

    And for each suffix and offset below ``span`` whether the run of ``least`` words that begins so many words before it is
    open: the words behind the suffix suffice with some neighbour, and none of a lower document has the whole run.
    """
    n = len(doc)
    right, left = _matrix(after, span), _matrix(before, span)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (head[1:] != head[:-1])))
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    me = np.arange(n)
    best = {"n": np.zeros(n, np.int64), "start": place.astype(np.int64), "end": place.astype(np.int64),
            "other": np.full(n, NO_ID), "other_start": np.zeros(n, np.int64), "lowest": doc.copy()}
    offsets = np.arange(span)[None, :]
    open_, lower = np.zeros((n, span), bool), np.zeros((n, span), bool)
    for near in (first[run] - 1, last[run] + 1):
        ok = (near >= 0) & (near < n)
        i, j = me[ok], near[ok]
        same = (head[i] == head[j]) & (doc[i] != doc[j])
        i, j = i[same], j[same]
        if not len(i):
            continue
        back = _common(left, i, j)
        ahead = least - span + 1 + _common(right, i, j)
        reached = ahead[:, None] >= least - offsets
        open_[i] |= reached
        lower[i] |= reached & (back[:, None] >= offsets) & (doc[j] < doc[i])[:, None]
        long = back + ahead >= least
        i, j, back, ahead = i[long], j[long], back[long], ahead[long]
        best["start"][i] = np.minimum(best["start"][i], place[i] - back)
        best["end"][i] = np.maximum(best["end"][i], place[i] + ahead)
        best["lowest"][i] = np.minimum(best["lowest"][i], doc[j])
        more = back + ahead > best["n"][i]
        i, j, back, ahead = i[more], j[more], back[more], ahead[more]
        best["n"][i] = back + ahead
        best["other"][i], best["other_start"][i] = doc[j], place[j] - back
    hit = np.flatnonzero(best["n"] > 0)
    times = np.array([len(places[i]) for i in hit], np.int64)
    each = np.repeat(hit, times)
    moved = np.array([p for i in hit for p in places[i]], np.int64) - place[each]
    out = {"doc": doc[each], **{k: v[each] for k, v in best.items()}}
    return out | {"start": out["start"] + moved, "end": out["end"] + moved}, open_ & ~lower & (left[1][:, None] >= offsets)


def run_keys(head: np.ndarray, after: list[bytes], before: list[bytes], span: int) -> np.ndarray:
    """For each suffix and offset, a hash of the run of ``least`` words that begins so many words before it."""
    right, left = (_matrix(v, span)[0].astype(np.uint64) for v in (after, before))
    ahead, back = np.empty((2, len(head), span), np.uint64)
    ahead[:, 0], back[:, 0] = head.view(np.uint64), 0
    for k in range(1, span):
        ahead[:, k] = mix(ahead[:, k - 1] * np.uint64(31) + right[:, k - 1] + np.uint64(1))
        back[:, k] = mix(back[:, k - 1] * np.uint64(31) + left[:, k - 1] + np.uint64(1))
    return mix(ahead[:, ::-1] ^ mix(back + np.arange(1, span + 1, dtype=np.uint64))).view(np.int64)


def _neighbours(ordered: DataFrame, least: int, span: int, opens: bool) -> DataFrame:
    """Matches within each sorted partition, and the partition's first and last rows (``edge`` numbers them).

    With ``opens`` also the suffixes that have open runs, with the keys and offsets of these.
    """
    schema = FOUND + (", edge bigint, place int, head bigint, after binary, before binary, places array<int>, "
                      "keys array<bigint>, offsets array<int>")
    types = {"doc": pa.int64(), "place": pa.int32(), "head": pa.int64(), "after": pa.binary(), "before": pa.binary(),
             "places": pa.list_(pa.int32()), "keys": pa.list_(pa.int64()), "offsets": pa.list_(pa.int32())}
    names = ["doc", "place", "head", "after", "before", "places"]

    def rows_of(batch: pa.RecordBatch) -> dict[str, list]:
        return {k: batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names}

    def result(columns: dict) -> pa.RecordBatch:
        n = len(columns["doc"])
        fields = [f.split(" ")[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_pydict({
            k: pa.array(columns[k], types.get(k, pa.int64())) if k in columns else pa.nulls(n, types.get(k, pa.int64())) for k in fields})

    def compare(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        doc, head = np.array(rows["doc"], np.int64), np.array(rows["head"], np.int64)
        found, open_ = matched(doc, np.array(rows["place"], np.int64), head, rows["after"], rows["before"], rows["places"], least, span)
        yield result(found)
        at = np.flatnonzero(open_.any(1)) if opens else []
        if len(at):
            pick = lambda k: [rows[k][i] for i in at]
            keys, open_ = run_keys(head[at], pick("after"), pick("before"), span), open_[at]
            yield result({"doc": doc[at], "head": head[at], "places": pick("places"),
                          "keys": [k[o].tolist() for k, o in zip(keys, open_, strict=True)],
                          "offsets": [np.flatnonzero(o).tolist() for o in open_]})

    def run(batches):
        held: dict[str, list] | None = None
        ends: dict[str, list] = {k: [] for k in names}
        tail: dict[str, list] = {k: [] for k in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = rows_of(batch)
            if len(ends["doc"]) < EDGE:
                for k in names:
                    ends[k] += rows[k][: EDGE - len(ends[k])]
            tail = {k: (tail[k] + rows[k])[-EDGE:] for k in names}
            if held:
                rows = {k: held[k] + rows[k] for k in names}
            yield from compare(rows)
            # What the next batch may still match: the last document's rows and the one before them.
            cut = len(rows["doc"]) - 1
            while cut and rows["doc"][cut - 1] == rows["doc"][-1] and rows["head"][cut - 1] == rows["head"][-1]:
                cut -= 1
            held = {k: rows[k][max(cut - 1, 0) :] for k in names}
        if ends["doc"]:
            edges = {k: ends[k] + tail[k] for k in names}
            yield result(edges | {"edge": np.arange(len(edges["doc"]))})

    return ordered.mapInArrow(run, schema)


def _sorted_matches(rows: DataFrame, order: list[str], least: int, span: int, opens: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matches of neighbours when suffixes are sorted by ``order``; and suffixes with open runs, if ``opens``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = staged(_neighbours(ordered, least, span, opens), "suffix-matches")
    # A few rows a partition; sorted again, the ends of one range meet the beginnings of the next.
    edges = out.filter("edge is not null").select("doc", "place", "head", "after", "before", "places").distinct()
    met = _neighbours(edges.coalesce(1).sortWithinPartitions(*order), least, span, opens)
    every = out.filter("edge is null").union(met.filter("edge is null"))
    names = lambda schema: [f.split(" ")[0] for f in schema.split(", ")]
    return every.filter("keys is null").select(*names(FOUND)), every.filter("keys is not null").select("doc", *names(OPEN))


def _lowest(opened: DataFrame, least: int) -> DataFrame:
    """Open runs that a lower document has open too, as matches with the lowest one."""
    heads = opened.groupBy("head").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("head")
    rows = opened.join(staged(heads, "suffix-open-heads"), "head")
    each = rows.select("doc", "places", F.explode(F.arrays_zip("keys", "offsets")).alias("run")).select(
        "doc", "places", F.col("run.keys").alias("key"), F.col("run.offsets").alias("offset"))
    each = staged(each, "suffix-open-runs")
    begin = lambda place: (place - F.col("offset")).cast("bigint")
    first = F.min(F.struct("doc", begin(F.get("places", F.lit(0))).alias("start"))).alias("first")
    lows = staged(each.groupBy("key").agg(first, F.max("doc").alias("high")).filter("first.doc < high").drop("high"), "suffix-lowest")
    held = each.join(lows, "key").filter("first.doc < doc").select("doc", F.explode("places").alias("place"), "offset", "first")
    return held.select(
        "doc", begin(F.col("place")).alias("start"), (begin(F.col("place")) + least).alias("end"), F.col("first.doc").alias("other"),
        F.col("first.start").alias("other_start"), F.lit(least).cast("bigint").alias("n"), F.col("first.doc").alias("lowest"))


def repeats(df: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """Maximal passages of ``least`` words or more that another document has too.

    One row per passage and document: doc_id, start_word and end_word (exclusive),
    n_words, other_doc_id with the longest match and where it begins there, and
    ``first``, whether no document of a lower id has a run of ``least`` words of it.
    """
    kept = staged(suffixes(df, least, span), "suffixes")
    often = kept.groupBy("head").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("head")
    common = staged(often, "suffix-heads")  # a plain table, so that a head in very many places can be split in the join
    places = kept.join(common, "head").groupBy("doc").agg(F.collect_list("place").alias("places"))
    rows = staged(_contexts(_named(df).join(places, "doc").select("doc", "text", "places"), least, span), "suffix-contexts")
    ties = ["doc", "place"]
    ahead, opened = _sorted_matches(rows, ["head", "after", "before", *ties], least, span, opens=True)
    back, _ = _sorted_matches(rows, ["head", "before", "after", *ties], least, span)
    both = ahead.union(back).union(_lowest(opened, least))
    by_doc = Window.partitionBy("doc").orderBy("start", "end", "other", "other_start")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("new", (F.coalesce(F.col("start") > reach, F.lit(True))).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    best = F.max(F.struct("n", (-F.col("other")).alias("k"), "other", "other_start"))
    return island.groupBy("doc", "island").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), best.alias("best"), F.min("lowest").alias("lowest")
    ).select(
        named("doc").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.when(F.col("best.other") != NO_ID, F.col("best.other")).alias("other_doc_id"),
        F.col("best.other_start").alias("other_start"), (F.col("lowest") >= F.col("doc")).alias("first"))
