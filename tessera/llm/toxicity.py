"""Toxicity by multiple-instance learning: a document is a bag of sentences, joined by noisy-or."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, bounded_batches, text_buffer
from .learning import SAMPLE, Adam, scored, training_rows

BITS = 18
#: Bytes of a word's beginnings that are features beside the word, for inflected forms.
PREFIXES = (4, 6)
THRESHOLD = 0.5
#: Bytes that end a sentence.
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
_MOST = 25.0


class Sentences:
    """Feature buckets of a batch's words, grouped by sentence; a text without words has no sentence."""

    def __init__(self, col: pa.Array):
        w = self.words = Words(col, PREFIXES)
        salted = [h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)) for k, h in ((0, w.hashes), *w.prefix.items())]
        self.bucket = np.stack([h >> np.uint64(64 - BITS) for h in salted]).astype(np.int32)  # (features of a word, words)
        ends = np.cumsum(np.concatenate([[0], _ENDS[w.raw]])) if len(w.raw) else np.zeros(1, np.int64)
        sentence = ends[w.starts]
        row = np.repeat(np.arange(len(w)), np.diff(w.of_row))
        new = np.ones(len(sentence), bool)
        new[1:] = (np.diff(sentence) > 0) | (np.diff(row) > 0)
        self.first = np.flatnonzero(new)
        self.row = row[self.first]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.bucket].sum(0), self.first) if len(self.first) else np.zeros(0)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.clip(z, -_MOST, _MOST))


@dataclass
class Model:
    """A weight for each hashed word and one bias. A sentence's probability is a logistic of its words' weights, none below 0."""

    weights: np.ndarray
    bias: float

    def sentences(self, s: Sentences) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s.sums(self.weights).astype(np.float64) + self.bias, -_MOST, _MOST)))

    def documents(self, s: Sentences) -> np.ndarray:
        """1 - product(1 - p) over a document's sentences; 0 for a text without words."""
        miss = _softplus(s.sums(self.weights).astype(np.float64) + self.bias)
        return -np.expm1(-np.bincount(s.row, miss, len(s.words)))

    def __call__(self, col: pa.Array) -> np.ndarray:
        return self.documents(Sentences(col))


#: Words that are looked at together in fitting.
_SLICE = 1 << 17


def fit(words: np.ndarray, first: np.ndarray, document: np.ndarray, y: np.ndarray, epochs: int = 60, decay: float = 2e-5) -> Model:
    """Likelihood of the document labels under noisy-or, walking the documents slice by slice.

    words: of each word its buckets, BITS each, in one number; first: where each sentence begins, in
    ascending order, 0 first; document: of each sentence, in ascending order.
    """
    edge = np.searchsorted(document, np.arange(len(y) + 1))  # sentences of each document
    ends = np.append(first, len(words))
    cuts, lo = [], 0
    while lo < len(y):
        hi = max(lo + 1, int(np.searchsorted(ends[edge], ends[edge[lo]] + _SLICE, "right")) - 1)
        cuts.append((lo, hi))
        lo = hi
    used = [k * BITS for k in range(1 + len(PREFIXES))]
    buckets = lambda a, b: [(words[a:b] >> k & ((1 << BITS) - 1)) for k in used]
    w, b, seen = np.zeros(1 << BITS), np.array([-6.0]), np.zeros(1 << BITS, np.int64)
    adam = Adam([w, b], 0.1)
    for epoch in range(epochs):
        to_w, to_b = np.full(len(w), decay), 0.0
        for lo, hi in cuts:
            s, e = edge[lo], edge[hi]
            if s == e:
                continue
            held = buckets(ends[s], ends[e])
            z = np.clip(np.add.reduceat(sum(w[x] for x in held), first[s:e] - first[s]) + b[0], -_MOST, _MOST)
            p = 1 / (1 + np.exp(-z))
            of = document[s:e] - lo
            none = np.exp(-np.bincount(of, _softplus(z), hi - lo))
            pull = np.where(y[lo:hi] == 1, -np.minimum(none / np.maximum(1 - none, 1e-6), 50.0), 1.0)
            g = p * pull[of] / len(y)
            each = np.repeat(g, np.diff(ends[s : e + 1]))
            for x in held:
                to_w += np.bincount(x, each, len(w))
                if not epoch:
                    seen += np.bincount(x, minlength=len(w))
            to_b += g.sum()
        adam.step([to_w, np.array([to_b])])
        np.maximum(w, 0, out=w)  # evidence only: a long harmless sentence can't outweigh an insult in it
    w[(w < 0.05) | (seen < 3)] = 0
    return Model(w.astype(np.float32), float(b[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """A model of the bounded sample of training_rows; texts become numbers on the executors, 8 bytes a word, which the driver reads in place."""
    rows = training_rows(docs, labels, label, most)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("words", pa.binary()), ("firsts", pa.binary())])

    def cut(batch: pa.RecordBatch) -> list:
        s = Sentences(batch.column("text"))
        edge = np.searchsorted(s.row, np.arange(len(s.words) + 1))
        packed = sum(x.astype(np.int64) << k * BITS for k, x in enumerate(s.bucket))
        words = [packed[s.words.of_row[i] : s.words.of_row[i + 1]].tobytes() for i in range(len(s.words))]
        firsts = [(s.first[edge[i] : edge[i + 1]] - s.words.of_row[i]).astype(np.int32).tobytes() for i in range(len(s.words))]
        return [batch.column("doc_id"), batch.column("y"), words, firsts]

    bounded_batches(docs.sparkSession)
    got = rows.mapInArrow(batches(cut, schema), "doc_id long, y int, words binary, firsts binary").toArrow().sort_by("doc_id").combine_chunks()

    def numbers(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of a binary column, and how many each row has."""
        col = got[name].cast(pa.large_binary()).combine_chunks() if got.num_rows else pa.array([], pa.large_binary())
        flat, sizes = text_buffer(col)
        return flat.view(kind), np.diff(sizes) // np.dtype(kind).itemsize

    (words, n_words), (firsts, n_firsts) = numbers("words", np.int64), numbers("firsts", np.int32)
    if not len(words):
        return Model(np.zeros(1 << BITS, np.float32), -6.0)
    base = np.cumsum(n_words) - n_words
    return fit(words, firsts + np.repeat(base, n_firsts), np.repeat(np.arange(len(n_firsts)), n_firsts), got["y"].to_numpy())


def classified(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted (replacing columns of those names); null and empty texts score 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda col: held.value(col), threshold)


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sentence, start, end, score, text) of each sentence with this probability; start and end count bytes of UTF-8."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])

    def find(batch: pa.RecordBatch) -> list:
        s = Sentences(batch.column("text"))
        p = held.value.sentences(s)
        at = np.flatnonzero(p >= threshold)
        w, last = s.words, np.append(s.first[1:], len(s.words.starts)) - 1
        begin, end = w.starts[s.first[at]], w.ends[last[at]]
        row = s.row[at]
        return [batch.column("doc_id").take(pa.array(row, pa.int64())), at - np.searchsorted(s.row, row), begin - w.rows[row], end - w.rows[row], p[at], [w.raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin, end, strict=True)]]

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(batches(find, schema), "doc_id long, sentence int, start long, end long, score double, text string")
