"""Benchmark decontamination with one Aho-Corasick automaton over words.

Questions and answers are normalised to words (A-Z in lower case, cut at every
other ASCII character that is no digit) and every ten consecutive words of an
item are a pattern. The automaton reads a document once, word by word, and names
every pattern that ends at each word; places of words in the normalised text
lead back to code points of the original.

Only the automaton travels to the tasks. The words of all items are counted
first; up to ``MAX_WORDS`` they make one automaton, beyond that they are dealt
into blocks of about that many, documents are scanned once per block, and only
the documents with hits are brought together again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorlog.llm.words import documents, texts_of
from spoorlog.session import staged

WINDOW = 10
#: Words of items in one automaton; ten nodes a word at most, some 300 MB.
MAX_WORDS = 200_000
PIECE = 4096
#: A-Z to a-z; what stands between words to a space. Bytes from 0x80 are letters.
NORMAL = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))
SPAN = "struct<first: int, last: int, start: int, end: int>"


def normal_bytes(text: str) -> bytes:
    """UTF-8 of a text, byte for byte as long, with spaces between the words."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL)


def offsets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in code points of the original text."""
    codes = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([False], codes != 0x20, [False])).astype(np.int8))
    before = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
    return before[np.flatnonzero(edge == 1)], before[np.flatnonzero(edge == -1)]


class Automaton:
    """Windows of items as patterns over word numbers."""

    def __init__(self, pieces: list[tuple[str, str]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        self.window_size: list[int] = []
        found: dict[tuple[int, ...], int] = {}
        for item, piece in pieces:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in piece.encode("utf-8", "surrogatepass").split(b" ")]
            for at in range(max(1, len(ids) - window + 1)):
                key = tuple(ids[at : at + window])
                if key not in found:
                    found[key] = len(self.items)
                    self.items.append(set())
                    self.window_size.append(len(key))
                self.items[found[key]].add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, n in found.items():
            self.machine.add_word(key, n)
        if found:
            self.machine.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Words of a normalised text, the runs of hit words (first, last, start, end), the items found."""
        words = raw.split()
        if not words or not self.items:
            return len(words), [], []
        seen, reach = set(), {}
        for end, pattern in self.machine.iter(tuple(map(self.number.get, words, repeat(0)))):
            seen.add(pattern)
            reach[end] = max(reach.get(end, 0), self.window_size[pattern])
        if not seen:
            return len(words), [], []
        runs: list[list[int]] = []
        for end in sorted(reach):
            first = end - reach[end] + 1
            while runs and runs[-1][0] >= first:
                runs.pop()
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = end
            else:
                runs.append([first, end])
        starts, ends = offsets(raw)
        return len(words), [(a, b, int(starts[a]), int(ends[b])) for a, b in runs], sorted(set().union(*(self.items[p] for p in seen)))


_built: dict[str, Automaton] = {}


def _automaton(name: str, pieces: list[tuple[str, str]], window: int) -> Automaton:
    """Built once in each Python worker; a worker holds one at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(pieces, window)
    return _built[name]


def item_pieces(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, piece, n: normalised words of the items.

    An item of more than ``PIECE`` words comes in several rows that overlap by all
    but one word of a window, so no row grows and no window is lost.
    """
    source = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, pieces, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                words = normal_bytes(text).split()
                for at in range(0, len(words), PIECE):
                    cut = words[at : at + PIECE + window - 1]
                    if at == 0 or len(cut) >= window:
                        names.append(item)
                        pieces.append(b" ".join(cut).decode("utf-8", "surrogatepass"))
                        sizes.append(len(cut))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.string()), pa.array(sizes, pa.int32())], ["item", "piece", "n"])

    return source.mapInArrow(run, "item string, piece string, n int").distinct()


def _scanned(docs: DataFrame, pieces: list[tuple[str, str]], name: str, window: int, hits_only: bool) -> DataFrame:
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, pieces, window)
        for batch in batches:
            found = [machine.scan(normal_bytes(t)) for t in texts_of(batch)]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([[dict(zip(("first", "last", "start", "end"), r)) for r in f[1]] for f in found], kind),
                 pa.array([f[2] for f in found], pa.list_(pa.string())),
                 *([batch.column(2)] if hits_only else [])],
                ["doc_id", "n_words", "spans", "item_ids", *(["digest"] if hits_only else [])])
            yield out.filter(pa.array([bool(f[1]) for f in found])) if hits_only else out

    more = ", digest binary" if hits_only else ""
    return docs.mapInArrow(run, f"doc_id bigint, n_words bigint, spans array<{SPAN}>, item_ids array<string>{more}")


def _joined_runs(spans: list[dict]) -> list[dict]:
    """Runs of words from several scans as one list of separate runs."""
    out: list[dict] = []
    for run in sorted(spans, key=lambda r: (r["first"], r["last"])):
        if out and run["first"] <= out[-1]["last"] + 1:
            if run["last"] > out[-1]["last"]:
                out[-1] |= {"last": run["last"], "end": run["end"]}
        else:
            out.append(dict(run))
    return out


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, spans, item_ids of every document.

    ``spans`` are the runs of words inside any occurrence of a window, as numbers
    of words (both ends included) and code points of the whole text (end excluded);
    ``item_ids`` are the items with a window that occurs, sorted as strings. An item
    of fewer words than a window is one window; without words it is none. Null
    texts have no words; a null item id is the empty string; items with the same id
    count once; repeated documents are rows of their own; other columns are not
    read. Without items no word is hit.
    """
    pieces = staged(item_pieces(items, window), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    docs = documents(docs).select("doc_id", "text")
    blocks = max(1, math.ceil(total / max_words))
    name = F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))

    def of_block(b: int) -> list[tuple[str, str]]:
        return [(r.item, r.piece) for r in pieces.filter(name == b).select("item", "piece").toLocalIterator()]

    key = pieces.inputFiles()[0] if total else "none"
    if blocks == 1:
        return _scanned(docs, of_block(0), key, window, False)
    keyed = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    hits = None
    for b in range(blocks):
        part = staged(_scanned(keyed.select("doc_id", "text", "digest"), of_block(b), f"{key}-{b}", window, True).distinct(), "hits")
        hits = part if hits is None else hits.union(part)
    merged = hits.groupBy(F.col("doc_id").alias("of"), "digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("spans")
            runs = pa.array([_joined_runs(s) for s in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), runs)

    merged = merged.mapInArrow(join_runs, merged.schema)
    return _with_hits(keyed, merged)


def _with_hits(keyed: DataFrame, merged: DataFrame) -> DataFrame:
    """Every document with what all blocks found in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(normal_bytes(t).split()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "digest", "n_words"])

    sized = keyed.mapInArrow(count, "doc_id bigint, digest binary, n_words bigint").withColumnRenamed("digest", "sha")
    same = (F.col("sha") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("of"))
    both = sized.join(merged, same, "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document of :func:`find`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
