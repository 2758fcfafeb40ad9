"""Topic models by passes over all documents, held as blocks of word counts in executors.

A pass infers each document's mixture against the topics of the pass before, going on from the document's own mixture of that pass,
and makes the topics, and the prior, anew of what all documents' words add up to. A document's rounds end as the
reference's do: when its mixture moves by less than SETTLED on average, or after ROUNDS of them in a pass.

Blocks stay where they are: a pass shuffles only the mixtures (k numbers for each document) and the tasks' sums (k numbers for each word
of the dictionary, which `topics.prepared` bounds). The order of rows and tasks doesn't show in the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import stored
from .variational import TINY, _parts, digamma, learned_prior

#: The reference's: passes, a document's rounds in a pass, and the mean change of its mixture at which they end.
PASSES, ROUNDS, SETTLED = 50, 100, 1e-3
#: Pairs of a document and a word that are worked on at once, unless a document has more; pairs of a partition, more or less.
_PAIRS, _PARTITION = 1 << 14, 1 << 22
#: Pairs of the blocks that a task holds at once, and words of a slice of its sums; rounds in which a block's documents stay together.
_ADDED, _SLICE, _FIRST = 1 << 20, 1 << 14, 4
_STATE = "kind int, block long, task int, held binary"


def blocks(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(block, pairs, docs, sizes, terms, counts) of (doc_id, tokens) rows: some documents each, with the number of their known words, the words' places in the vocabulary and their counts."""
    spark = rows.sparkSession
    words = spark.sparkContext.broadcast(vocabulary)
    kind = rows.schema["doc_id"].dataType.simpleString()
    given = rows.select("doc_id", "tokens")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = pa.array(words.value), len(words.value)
        block = TaskContext.get().partitionId() << 33
        for batch in it:
            tokens = batch.column("tokens")
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            ids = pc.fill_null(pc.index_in(tokens.flatten(), known), -1).to_numpy(zero_copy_only=False)
            pairs, n = np.unique((row * v + ids)[ids >= 0], return_counts=True)
            row, terms = np.divmod(pairs, v) if v else (pairs, pairs)
            of = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lo = 0
            while lo < batch.num_rows:
                hi = min(max(int(np.searchsorted(of, of[lo] + _PAIRS, "right")) - 1, lo + 1), lo + _PAIRS)
                part = slice(of[lo], of[hi])
                columns = [np.diff(of[lo : hi + 1]), terms[part], n[part]]
                docs = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("doc_id").slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(of[hi] - of[lo])]), docs, *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in columns]], names=["block", "pairs", "docs", "sizes", "terms", "counts"])
                block, lo = block + 1, hi

    return given.mapInArrow(run, f"block long, pairs long, docs array<{kind}>, sizes binary, terms binary, counts binary")


def settled(of: np.ndarray, n: np.ndarray, b: np.ndarray, gamma: np.ndarray, alpha: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(the mixtures (topics, documents), the documents that haven't settled) after rounds from gamma: each document's until it settles; of: where its words begin, and the end; b: (topics, words) weights.

    Documents that have settled are left out of further rounds. Those without words have the prior.
    """
    out, sizes = np.repeat(alpha[:, None], len(of) - 1, axis=1), np.diff(of)
    at = np.flatnonzero(sizes)
    g, sizes = gamma[:, at], sizes[at]
    moves = np.ones(len(at), bool)
    for _ in range(rounds):
        if not len(at):
            break
        theta = np.exp(digamma(g))
        shares = np.repeat(theta, sizes, axis=1)
        shares *= b
        np.multiply(b, n / (shares.sum(0) + TINY), out=shares)
        new = alpha[:, None] + theta * np.add.reduceat(shares, np.append(0, np.cumsum(sizes[:-1])), axis=1)
        moves = np.abs(new - g).mean(0) >= SETTLED
        g = new
        if sizes[moves].sum() <= 0.7 * len(n):
            out[:, at] = g
            kept = np.repeat(moves, sizes)
            at, g, sizes, n, b = at[moves], g[:, moves], sizes[moves], n[kept], np.compress(kept, b, axis=1)
            moves = moves[moves]
    out[:, at] = g
    return out, at[moves]


def _all_settled(held: list[tuple[np.ndarray, ...]], beta: np.ndarray, alpha: np.ndarray) -> list[np.ndarray]:
    """The mixtures of some blocks (sizes, of, terms, counts, gamma). After _FIRST rounds, what hasn't settled is put together, so that few documents don't keep a block's rounds going."""
    out, left = [], []
    for i, (sizes, of, at, n, gamma) in enumerate(held):
        made, moving = settled(of, n, np.take(beta, at, axis=1), gamma, alpha, _FIRST)
        out.append(made)
        if len(moving):
            kept = np.repeat(np.isin(np.arange(len(sizes)), moving), sizes)
            left.append((np.full(len(moving), i), moving, sizes[moving], at[kept], n[kept], made[:, moving]))
    if not left:
        return out
    block, doc, sizes, at, n = (np.concatenate(x) for x in list(zip(*left))[:5])
    gamma, of = np.concatenate([x[5] for x in left], axis=1), np.append(0, np.cumsum(sizes, dtype=np.int64))
    for lo, hi in _parts(of, _PAIRS):
        words = slice(of[lo], of[hi])
        made, _ = settled(of[lo : hi + 1] - of[lo], n[words], np.take(beta, at[words], axis=1), gamma[:, lo:hi], alpha, ROUNDS - _FIRST)
        for i in np.unique(block[lo:hi]):
            mine = block[lo:hi] == i
            out[i][:, doc[lo:hi][mine]] = made[:, mine]
    return out


def _held(row: dict, k: int) -> tuple[np.ndarray, ...]:
    sizes, terms, counts = (np.frombuffer(row[c], np.int32) for c in ("sizes", "terms", "counts"))
    of = np.append(0, np.cumsum(sizes, dtype=np.int64))
    gamma = np.ones((k, len(sizes))) if row["held"] is None else np.frombuffer(row["held"]).reshape(k, -1)
    return sizes, of, terms, counts.astype(float), gamma


def _groups(it: Iterator[pa.RecordBatch], k: int) -> Iterator[list]:
    """Some rows at a time, with _ADDED pairs or somewhat more: (block, or its documents' ids, held)."""
    rows, n = [], 0
    for batch in it:
        name = "block" if "block" in batch.schema.names else "docs"
        for i in range(batch.num_rows):
            held = _held({c: batch.column(c)[i].as_py() for c in ("sizes", "terms", "counts", "held")}, k)
            rows.append((batch.column(name)[i], held))
            n += len(held[2]) + len(held[0])
            if n >= _ADDED:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def _with_state(corpus: DataFrame, state: DataFrame | None) -> DataFrame:
    """corpus with the documents' mixtures of the pass before; only these are shuffled, as the corpus is dealt by block already."""
    if state is None:
        return corpus.withColumn("held", F.lit(None).cast("binary"))
    return corpus.join(state.hint("shuffle_hash"), "block", "left")


def _inferred(corpus: DataFrame, state: DataFrame | None, weights: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """Rows of kind 0, a block's mixtures; of kind 1, a task's sums for a slice of the words; and of kind 2, documents with words and their expected log mixtures."""
    k, v = weights.shape
    given = corpus.sparkSession.sparkContext.broadcast(weights)
    names = ["kind", "block", "task", "held"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, stats, sums, task = given.value, np.zeros((k, v)), np.zeros(1 + k), TaskContext.get().partitionId()
        made = lambda kind, at, values: pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at]), pa.array([task], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=names)
        for rows in _groups(it, k):
            mixtures, shares = _all_settled([held for _, held in rows], beta, alpha), []
            for (block, (sizes, _, at, n, _)), gamma in zip(rows, mixtures, strict=True):
                yield made(0, block.as_py(), gamma)
                some = gamma[:, sizes > 0]
                expected = digamma(some) - digamma(some.sum(0))
                each = np.repeat(np.exp(expected), sizes[sizes > 0], axis=1)
                each *= np.take(beta, at, axis=1)
                each *= n / (each.sum(0) + TINY)
                shares.append(each)
                sums[0] += some.shape[1]
                sums[1:] += expected.sum(1)
            at = np.concatenate([held[2] for _, held in rows])
            for i in range(k):
                stats[i] += np.bincount(at, np.concatenate([x[i] for x in shares]), v)
        for lo in range(0, v, _SLICE):
            yield made(1, lo, stats[:, lo : lo + _SLICE])
        yield made(2, 0, sums)

    return _with_state(corpus.select("block", "sizes", "terms", "counts"), state).mapInArrow(run, _STATE)


def _summed(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The sums of all tasks' rows of equal kind and block, in the order of tasks."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        parts = t.sort_by("task").column("held").to_pylist()
        total = sum((np.frombuffer(x) for x in parts[1:]), np.frombuffer(parts[0]))
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "block": [key[1].as_py()], "held": pa.array([total.tobytes()], pa.binary())})

    summed = rows.select("kind", "block", "task", "held").groupBy("kind", "block").applyInArrow(add, "kind int, block long, held binary")
    return {(r["kind"], r["block"]): np.frombuffer(r["held"]) for r in summed.collect()}  # bounded by the dictionary


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@dataclass
class Model:
    """Topics (a weight for each topic and word), the prior of mixtures, and the documents' mixtures (block, held) of the last pass."""

    vocabulary: list[str]
    weights: np.ndarray
    alpha: np.ndarray
    passes: int
    mixtures: DataFrame

    def getMaxIter(self) -> int:  # noqa: N802  as the library's models say it
        return self.passes

    def getSubsamplingRate(self) -> float:  # noqa: N802
        """Each pass reads every document once."""
        return 1.0


def _expected(weights: np.ndarray) -> np.ndarray:
    return np.exp(digamma(weights) - digamma(weights.sum(1, keepdims=True)))


class Corpus:
    """The blocks of (doc_id, tokens, …) rows with a dictionary, held by the executors until the with block ends."""

    def __init__(self, rows: DataFrame, dictionary: CountVectorizerModel):
        self.vocabulary, self.spark = list(dictionary.vocabulary), rows.sparkSession
        self.rows = rows

    def __enter__(self) -> Corpus:
        made = stored(blocks(self.rows, self.vocabulary), "blocks")
        pairs = made.agg(F.sum("pairs")).first()[0] or 0
        parts = max(self.spark.sparkContext.defaultParallelism, -(-pairs // _PARTITION))
        self.blocks = made.repartition(parts, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *_: object) -> None:
        self.blocks.unpersist()

    def fit(self, k: int, alpha: str | float = "auto", seed: int = 0, passes: int = PASSES) -> Model:
        """A model after some passes over all documents from random topics; alpha 'auto' learns the prior, by a step in each pass that shrinks as the reference's."""
        from ..sources.sinks import scratch

        v = len(self.vocabulary)
        prior = np.full(k, 1 / k if alpha == "auto" else float(alpha))
        weights, state = np.random.default_rng(seed).gamma(100.0, 0.01, (k, v)), None
        before = None
        for p in range(1, passes + 1):
            path = scratch(self.spark, "pass")
            _inferred(self.blocks, state, _expected(weights), prior).write.parquet(path)
            made = self.spark.read.schema(_STATE).parquet(path)
            state = made.where("kind = 0").select("block", "held")
            held = _summed(made.where("kind > 0"))
            sums = held.pop((2, 0))
            weights = 1 / k + np.concatenate([held[at].reshape(k, -1) for at in sorted(held)], axis=1)
            if alpha == "auto":
                step = (1 + p) ** -0.5
                prior = (1 - step) * prior + step * learned_prior(prior, sums[1:], sums[0], rounds=1) if sums[0] else prior
            if before:
                _drop(self.spark, before)
            before = path
        return Model(self.vocabulary, weights, prior, passes, state)

    def mixtures(self, model: Model) -> DataFrame:
        """(doc_id, probabilities, dominant_topic) of all documents against a model's topics, stored; those without known words have the prior's."""
        weights, alpha, kind = _expected(model.weights), model.alpha, self.blocks.schema["docs"].dataType
        given = self.spark.sparkContext.broadcast(weights)
        from pyspark.sql.pandas.types import to_arrow_type

        doc = to_arrow_type(kind.elementType)
        k = len(alpha)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _groups(it, k):
                for (docs, _), gamma in zip(rows, _all_settled([held for _, held in rows], given.value, alpha), strict=True):
                    made = (gamma / gamma.sum(0)).T
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, k), pa.int32()), pa.array(made.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([docs.values.cast(doc), lists], names=["doc_id", "probabilities"])

        placed = _with_state(self.blocks.select("block", "docs", "sizes", "terms", "counts"), model.mixtures).drop("block")
        made = placed.mapInArrow(run, f"doc_id {kind.elementType.simpleString()}, probabilities array<double>")
        return stored(made.withColumn("dominant_topic", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")), "mixtures")


def top_terms(model: Model, spark: SparkSession, n: int = 20) -> DataFrame:
    """(topic_id, rank, term, weight), n terms of each topic; weights are shares of all the topic's words, the first in the dictionary of equal ones comes first."""
    shares = model.weights / model.weights.sum(1, keepdims=True)
    rows = [(t, r + 1, model.vocabulary[i], float(x[i])) for t, x in enumerate(shares) for r, i in enumerate(np.argsort(-x, kind="stable")[:n])]
    return spark.createDataFrame(rows, "topic_id int, rank int, term string, weight double")  # n for each topic
