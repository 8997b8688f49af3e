"""Words of many texts at once, as numpy arrays.

Texts of an Arrow batch are cut into blocks of about a million code points. One
block is one array, each text followed by a line feed, so a step over all its
words is a handful of array operations whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Beyond the last assigned letter; the last entry is of a code point that is none.
TABLE = 0x33480
#: White space of a word pattern [^\x20\x09-\x0D]+
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def fold_table() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    lower = (chr(i).lower() for i in range(TABLE))
    return np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(lower)], np.uint32)


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(TABLE)])


@cache
def word_table() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(TABLE)])


@cache
def space_table() -> np.ndarray:
    table = np.zeros(TABLE, bool)
    table[list(SPACES)] = True
    return table


def look(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Entries of a table; code points beyond it count as its last one."""
    return table[np.minimum(codes, TABLE - 1)]


def folded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < TABLE, look(fold_table(), codes), codes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, for n places."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), BLOCK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end]; equal contents, equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Texts as one array of code points, with the place of each text in it."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.text_at = np.zeros(self.n + 1, np.int64)
        np.cumsum(sizes, out=self.text_at[1:])
        raw = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.text_at, places, side="right") - 1

    def words(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of true places; the last place of a text is never one."""
        edge = np.diff(np.concatenate(([False], member, [False])).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def space_words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words(~look(space_table(), self.codes))


def blocks(texts: list[str], limit: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """The texts in order, in blocks of about ``limit`` code points, with the first text's index."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= limit:
            yield first, Block(texts[first : i + 1])
            first, size = i + 1, 0
    if first < len(texts):
        yield first, Block(texts[first:])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as a list; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, list[str]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``fn`` on each Arrow batch; every dict of columns it yields is a batch of the result."""
    names = [f.strip().split(" ")[0] for f in _fields(schema)]

    def run(batches):
        for batch in batches:
            for out in fn(batch, texts_of(batch)):
                yield pa.RecordBatch.from_pydict({k: out[k] for k in names})

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    fields, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append("")
        else:
            fields[-1] += c
    return fields


def id_remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, whatever else the table carries; null text is empty."""
    return df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
