"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability sigmoid(bias + sum
of its words' weights), a document 1 - product(1 - p): it is toxic if any
sentence is (noisy-or). Only documents carry labels; the gradient through the
noisy-or gives each sentence its share, so the model also says where.

Words are runs of letters and digits in lower case; a word counts once a
sentence. Its weight is the sum of three, for itself and for its first four and
five letters, so an unseen form of a known stem is recognised; each is hashed to
2**18 places. Sentences end at ``. ! ?`` or a line feed. Training uses at most
about ``per_label`` documents of each label, chosen by a hash of the id (a
documented bound); what fewer than ``least`` of them have gets no weight. Each
counts by the inverse of its label's share in the sample, so that scores follow
the labels of all rows, however many there are.

Null or empty texts, and texts without words, score 0. Rows are independent.
Without labelled rows of both kinds every score is 0. Documents labelled twice
count by their largest label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorlog.llm.words import Block, blocks, documents, folded, id_remainder, look, map_texts, mix, span_hashes, word_table
from spoorlog.session import staged

BITS = 18
STEMS = (4, 5)
ENDS = [ord(c) for c in ".!?\n"]


def held_out() -> Column:
    return id_remainder(5) == 0


def bag(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (three a word) and sentence of each sentence's distinct words; first place and text of each sentence."""
    codes = folded(block.codes)
    starts, ends = block.words(look(word_table(), codes))
    stop = np.cumsum(np.isin(block.codes, np.array(ENDS, np.uint32)))
    _, first, sentence = np.unique(stop[starts], return_index=True, return_inverse=True)
    place = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    word = span_hashes(codes, starts, ends)
    _, once = np.unique((sentence << BITS) | place(word), return_index=True)
    a, b = starts[once], ends[once]
    stems = [place(mix(span_hashes(codes, a, np.minimum(b, a + n)) + np.uint64(n))) for n in STEMS]
    return np.stack([place(word[once]), *stems], 1), sentence[once], starts[first], block.text_of(starts[first])


class Model:
    """Weights of hashed features and a bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def sentences(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log(1 - p), first place and text of each sentence."""
        feature, sentence, first, text = bag(block)
        z = np.bincount(sentence, self.weights[feature].sum(1), minlength=len(first)) + self.bias
        return -np.logaddexp(0, z), first, text


def fit(feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, least: int, rounds: int = 100,
        lasso: float = 1e-4, rate: float = 0.1, weight: np.ndarray | None = None) -> Model:
    """Minimise the noisy-or log loss plus a lasso; ``doc`` is the document of each sentence, ``weight`` what each document counts (mean 1).

    The lasso leaves a few hundred features, so words that merely sat in a toxic
    document by chance weigh nothing.
    """
    n_doc, width = len(label), feature.shape[1]
    weights = np.zeros(1 << BITS)
    if not len(label) or label.all() or not label.any():
        return Model(weights, -50.0)
    seen = np.zeros(1 << BITS, np.int64)
    for k in range(width):
        seen += np.bincount(np.unique((doc[sentence] << BITS) | feature[:, k]) & ((1 << BITS) - 1), minlength=1 << BITS)
    # Each distinct word once: a step works on words, then on their few features.
    words, x = np.unique(feature, axis=0, return_inverse=True)
    x = x.reshape(-1)
    on = seen[words] >= least
    useful = on.any(1)[x]
    x, s = x[useful], sentence[useful]
    theta, bias = np.zeros(1 << BITS), -4.0
    moments = np.zeros((2, (1 << BITS) + 1))
    for step in range(1, rounds + 1):
        score = (theta[words] * on).sum(1)
        z = np.bincount(s, score[x], minlength=len(doc)) + bias
        clean = np.bincount(doc, -np.logaddexp(0, z), minlength=n_doc)  # log of no toxic sentence
        pull = np.where(label == 1, -1 / np.maximum(np.expm1(np.minimum(-clean, 50)), 1e-6), 1.0)
        g = (pull if weight is None else pull * weight)[doc] / (1 + np.exp(-z))
        each = np.bincount(x, g[s], minlength=len(words))
        grad = np.append(np.bincount(words[on], np.broadcast_to(each[:, None], on.shape)[on], minlength=1 << BITS), g.sum()) / n_doc
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        scale = rate / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-5)
        move = scale * moments[0] / (1 - 0.9**step)
        theta, bias = theta - move[:-1], bias - move[-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - scale[:-1] * lasso, 0)
    return Model(np.where(seen >= least, theta, 0).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2500, least: int = 3) -> Model:
    """A model of ``labels`` (doc_id, toxic) over the texts of ``docs``."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share, most, parts = F.lit(0.0), 0.0, {}
    for row in known.groupBy("toxic").count().collect():  # two rows
        part = parts[row["toxic"]] = min(1.0, per_label / row["count"])
        share, most = F.when(F.col("toxic") == row["toxic"], F.lit(part)).otherwise(share), max(part, most)
    draw = F.xxhash64(F.lit(131), "doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    # The sample is written first: a few thousand ids, whose size Spark then knows, find their
    # texts without a shuffle of the rest, which the same draw has thinned out anyway.
    chosen = staged(known.filter(draw < share), "toxic-sample")
    rows = documents(docs).filter(draw < F.lit(most)).join(chosen, "doc_id")

    def bags(batch: pa.RecordBatch, texts: list[str]) -> Iterator[dict]:
        ids, toxic = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "toxic"))
        for first, block in blocks(texts):
            feature, sentence, _, text = bag(block)
            cut = np.searchsorted(text[sentence], np.arange(block.n + 1))
            yield {
                "doc_id": ids[first : first + block.n], "toxic": toxic[first : first + block.n],
                "feature": [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)],
                "sentence": [sentence[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)],
            }

    sample = map_texts(rows, bags, "doc_id bigint, toxic int, feature binary, sentence binary").collect()  # 2 x per_label rows
    sample.sort(key=lambda r: (r["doc_id"], r["feature"]))
    feature, sentence, doc, n = [], [], [], 0
    for i, r in enumerate(sample):
        own, s = np.unique(np.frombuffer(r["sentence"], np.int32), return_inverse=True)
        feature.append(np.frombuffer(r["feature"], np.int32).reshape(-1, 1 + len(STEMS)))
        sentence.append(s + n)
        doc.append(np.full(len(own), i))
        n += len(own)
    weight = np.array([1 / parts[r["toxic"]] for r in sample])
    weight /= max(weight.sum(), 1) / max(len(weight), 1)
    empty = [np.zeros(0, np.int64)]
    return fit(np.concatenate([*feature, np.zeros((0, 1 + len(STEMS)))]).astype(np.int64), np.concatenate(sentence + empty).astype(np.int64),
               np.concatenate(doc + empty).astype(np.int64), np.array([r["toxic"] for r in sample], np.int64), least, weight=weight)


def predict(df: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, and the offending sentences (probability ``limit`` or more).

    ``n_offending`` counts them, ``worst_at`` is the code point where the likeliest begins
    (-1 without sentences), ``spans`` joins the places they begin at.
    """

    def fn(batch: pa.RecordBatch, texts: list[str]) -> Iterator[dict]:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for first, block in blocks(texts):
            clean, place, text = model.sentences(block)
            total = np.bincount(text, clean, minlength=block.n)
            score = np.clip(-np.expm1(total), 0, 1)
            bad = clean <= np.log1p(-limit)
            at = place - block.text_at[text]
            worst = np.full(block.n, -1, np.int64)
            order = np.lexsort((-at, -clean, text))  # the last of a text is its likeliest and first
            worst[text[order]] = at[order]
            spans: list[list[str]] = [[] for _ in range(block.n)]
            for i in np.flatnonzero(bad):
                spans[text[i]].append(str(at[i]))
            yield {
                "doc_id": ids.slice(first, block.n), "score": score, "predicted": (score >= 0.5).astype(np.int32),
                "n_offending": np.bincount(text[bad], minlength=block.n), "worst_at": worst,
                "spans": [",".join(x) for x in spans],
            }

    return map_texts(documents(df), fn, "doc_id bigint, score double, predicted int, n_offending bigint, worst_at bigint, spans string")
