"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_buffer
from .learning import SAMPLE, Adam, scored, training_rows

#: A chunk is CHUNK bytes; the next one starts STRIDE, half of it, further.
CHUNK, STRIDE = 16, 8
WIDTH, FILTERS = 8, 24
THRESHOLD = 0.3
_PIECE = 1 << 19


@dataclass
class Network:
    """Byte vectors, filters over overlapping chunks, the largest response of each filter in the document, a logistic of those."""

    vectors: np.ndarray  # (257, WIDTH); 256 is padding
    filters: np.ndarray  # (CHUNK * WIDTH, FILTERS)
    shift: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 1, s).astype(np.float32)
        return cls(f(257, WIDTH) * 0.5, f(CHUNK * WIDTH, FILTERS) / np.float32(np.sqrt(CHUNK * WIDTH / 4)), np.zeros(FILTERS, np.float32), f(FILTERS) * 0.3, np.zeros(1, np.float32))

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Of each chunk of a text of some bytes; halves of chunks are multiplied once each."""
        n = max(2, -(-len(raw) // STRIDE))
        padded = np.full(n * STRIDE, 256, np.int64)
        padded[: len(raw)] = raw
        half = self.vectors[padded].reshape(n, STRIDE * WIDTH)
        return half[:-1] @ self.filters[: STRIDE * WIDTH] + half[1:] @ self.filters[STRIDE * WIDTH :] + self.shift

    def pooled(self, raw: np.ndarray) -> np.ndarray:
        """The whole text piece by piece, neighbours overlapping by half a chunk, so that memory is bounded."""
        best = np.zeros(FILTERS, np.float32)
        for at in range(0, max(1, len(raw) - STRIDE), _PIECE):  # no piece of half a chunk, which the one before holds
            np.maximum(best, self.responses(raw[at : at + _PIECE + STRIDE]).max(0), out=best)
        return best

    def __call__(self, col: pa.Array) -> np.ndarray:
        raw, rows = text_buffer(col)
        h = np.stack([self.pooled(raw[a:b]) for a, b in zip(rows, rows[1:], strict=False)]) if len(rows) > 1 else np.zeros((0, FILTERS))
        return 1 / (1 + np.exp(-np.clip(h @ self.weights + self.bias, -30, 30).astype(np.float64)))


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 5) -> Network:
    """Cross-entropy by Adam; the gradient of a filter passes through its best chunk of each document."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    adam = Adam([net.vectors, net.filters, net.shift, net.weights, net.bias], rate)
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        adam.rate = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            best, chunks = [], []
            for i in some:
                raw = texts[i][int(r.integers(0, STRIDE)) :]  # another alignment of the chunks each time
                z = net.responses(raw)
                top = z.argmax(0)
                best.append(z[top, np.arange(FILTERS)])
                at = top[:, None] * STRIDE + np.arange(CHUNK)
                chunks.append(np.where(at < len(raw), raw[np.minimum(at, max(len(raw) - 1, 0))], 256) if len(raw) else np.full(at.shape, 256))
            best, chunks = np.stack(best), np.stack(chunks)  # (batch, FILTERS), (batch, FILTERS, CHUNK)
            h = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.weights + net.bias, -30, 30)))
            g = ((p - y[some]) / len(some)).astype(np.float32)
            back = g[:, None] * net.weights * (best > 0)
            x = net.vectors[chunks].reshape(len(some), FILTERS, -1)
            to_filters = np.einsum("bfk,bf->kf", x, back) + 1e-5 * net.filters
            to_x = (back[:, :, None] * net.filters.T).reshape(-1, WIDTH)
            to_vectors = np.stack([np.bincount(chunks.ravel(), to_x[:, d], 257) for d in range(WIDTH)], 1).astype(np.float32)
            adam.step([to_vectors, to_filters.astype(np.float32), back.sum(0), h.T @ g + 1e-4 * net.weights, g.sum(keepdims=True)])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Network:
    """A network of the bounded sample of training_rows; without any it scores 0.5."""
    got = training_rows(docs, labels, label, most).toArrow().sort_by("doc_id")
    if not got.num_rows:
        net = Network.new()
        net.weights[:] = 0
        return net
    raw, rows = text_buffer(got["text"])
    y = got["y"].to_numpy().astype(np.float32)
    return fit([raw[a:b] for a, b in zip(rows, rows[1:], strict=False)], y)


def classified(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted (replacing columns of those names); null texts score as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    return scored(docs, lambda col: held.value(col), threshold)
