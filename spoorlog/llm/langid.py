"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of -1 and 1, drawn from its code point.
An n-gram is the product of its letters' vectors, each rolled by its place; a
text is the sum of its n-grams, a language the sum of its training texts. A
document gets the language whose profile has the largest cosine with it.

Letters are folded to lower case; anything else between letters is one space.
Training reads at most about ``per_lang`` documents a language, chosen by a hash
of the id, so it does not grow with the corpus. Null or letterless texts are
``und`` with score 0. Without training rows every text is ``und``. Ties go to
the language that sorts first. Rows are independent: repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorlog.llm.words import Block, blocks, documents, folded, id_remainder, letter_table, look, map_texts

UNKNOWN = "und"


@lru_cache(maxsize=8192)
def letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    """The random vector of a letter; code 0 is the space between words."""
    draw = np.random.Generator(np.random.Philox(key=[seed, code])).integers(0, 2, dim, dtype=np.int8)
    return draw * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, alphabet: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bound vectors of trigrams given as three columns of places in the alphabet."""
    letters = np.stack([letter_vector(int(c), dim, seed) for c in alphabet])
    return np.roll(letters, 2, 1)[grams[:, 0]] * np.roll(letters, 1, 1)[grams[:, 1]] * letters[grams[:, 2]]


def text_vectors(block: Block, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled trigram vectors of a block's texts, and their number of letters."""
    codes = folded(block.codes)
    codes = np.where(look(letter_table(), codes), codes, 0)
    text = np.repeat(np.arange(block.n), np.diff(block.text_at))
    keep = np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.int64)
    text = np.concatenate(([0], text[keep], [block.n - 1]))
    alphabet, x = np.unique(codes, return_inverse=True)
    letters = np.bincount(text[codes != 0], minlength=block.n)
    middle = codes[1:-1] != 0
    valid = middle | (text[:-2] == text[2:]) & (codes[:-2] != 0) & (codes[2:] != 0)
    owner = np.where(middle, text[1:-1], text[:-2])[valid]
    size = len(alphabet)
    key = ((x[:-2] * size + x[1:-1]) * size + x[2:])[valid]
    if size**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(key, minlength=size**3))
        place = np.zeros(size**3, np.int64)
        place[seen] = np.arange(len(seen))
        column = place[key]
    else:
        seen, column = np.unique(key, return_inverse=True)
    out = np.zeros((block.n, dim), np.float32)
    for first in range(0, len(seen), 8192):  # bounds the n-gram matrix
        part = seen[first : first + 8192]
        grams = np.stack([part // size**2, part // size % size, part % size], 1)
        mine = (column >= first) & (column < first + len(part)) if len(seen) > 8192 else slice(None)
        cell = owner[mine] * len(part) + (column[mine] - first)
        counts = np.bincount(cell, minlength=block.n * len(part)).reshape(block.n, len(part))
        out += counts.astype(np.float32) @ gram_vectors(grams, alphabet, dim, seed).astype(np.float32)
    return out, letters


@dataclass
class Profiles:
    """Language profiles: names in order, unit vectors, and how they were drawn."""

    langs: list[str]
    vectors: np.ndarray
    dim: int
    seed: int


def training_rows(docs: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` documents of each known language, chosen by a hash of the id."""
    known = documents(docs, F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().collect()  # one row per language
    draw = (F.xxhash64(F.lit(97), "doc_id").bitwiseAND(F.lit((1 << 31) - 1))) / F.lit(float(1 << 31))
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, per_lang / row["count"]))).otherwise(share)
    return known.filter(draw < share)


def train(docs: DataFrame, per_lang: int = 1000, dim: int = 1024, seed: int = 7) -> Profiles:
    """Profiles from the rows of ``docs`` with a language; text and lang are all it reads."""

    def bundle(batch: pa.RecordBatch, texts: list[str]) -> Iterator[dict]:
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), dtype=object)
        for first, block in blocks(texts, 1 << 18):
            vectors, _ = text_vectors(block, dim, seed)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            own = langs[first : first + block.n]
            for lang in sorted(set(own)):
                total = vectors[own == lang].sum(0, dtype=np.float64)
                yield {"lang": [lang] * dim, "place": np.arange(dim), "x": total}

    parts = map_texts(training_rows(docs, per_lang), bundle, "lang string, place bigint, x double")
    rows = parts.groupBy("lang", "place").agg(F.sum("x").alias("x")).collect()  # languages x dim
    langs = sorted({r["lang"] for r in rows})
    vectors = np.zeros((len(langs), dim))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        vectors[at[r["lang"]], r["place"]] = r["x"]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Profiles(langs, np.round(vectors, 6).astype(np.float32), dim, seed)


def predict(df: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), margin to the second language; one row per input row."""

    def score(batch: pa.RecordBatch, texts: list[str]) -> Iterator[dict]:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for first, block in blocks(texts):
            vectors, letters = text_vectors(block, profiles.dim, profiles.seed)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            n = len(profiles.langs)
            cosine = vectors @ profiles.vectors.T if n else np.zeros((block.n, 1), np.float32)
            best = cosine.argmax(1)
            top = np.sort(cosine, axis=1)
            found = (letters > 0) & (n > 0)
            yield {
                "doc_id": ids.slice(first, block.n),
                "lang_pred": [profiles.langs[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)],
                "score": np.where(found, np.clip(top[:, -1], 0, 1), 0).astype(np.float64),
                "margin": np.where(found, top[:, -1] - (top[:, -2] if n > 1 else 0), 0).astype(np.float64),
            }

    return map_texts(documents(df), score, "doc_id bigint, lang_pred string, score double, margin double")


def keep_accepted(df: DataFrame, profiles: Profiles, enough: int = 100) -> DataFrame:
    """The rows of ``df``, all columns, whose language can be told or may be; decided in one pass, no join.

    Texts without letters go. So do texts of ``enough`` letters that no language
    explains: unrelated texts have a cosine of about 1 / sqrt(dim), and three times
    that is the limit. A shorter text gives no ground to reject it, and where no row
    has a language, so that there are no profiles, no text with letters is rejected.
    """
    schema = df.schema
    at = df.columns.index("text")

    def run(batches):
        limit = 3 / profiles.dim**0.5
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = []
            for _, block in blocks(texts):
                vectors, letters = text_vectors(block, profiles.dim, profiles.seed)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = (vectors @ profiles.vectors.T).max(1) if profiles.langs else np.full(block.n, np.inf)
                keep.extend(((letters > 0) & ((best > limit) | (letters < enough))).tolist())
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, schema)


def held_out() -> Column:
    return id_remainder(3) == 1
