"""Latent Dirichlet allocation by variational Bayes: topics of new documents, and training whose bound never falls.

A topic table has a row for each term, (term, weights): one weight for each topic. Training keeps a table of
passes in a folder: each pass begins with the topic table and the documents' own mixtures that the pass before wrote, so a run
that was broken off goes on where it stopped and gives what it would have given. What passes add up over documents is
added up as decimals, so the order of partitions doesn't show.

Documents without any known term have the mixture of the prior; null and repeated doc_ids are documents like others in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of a document's inference, and a pass's rounds, which go on from the mixtures of the pass before.
STEPS, PASS_STEPS = 50, 5
#: Weight of a topic of no word at all.
TINY = 1e-100
#: Words of documents that are worked on at once, unless one has more.
_WORDS = 1 << 17
#: Sums over documents are exact to this many places.
_EXACT = "decimal(38,12)"
_STATE = "doc_id {}, terms array<int>, counts array<int>, gamma array<double>"


def digamma_column(x: Column) -> Column:
    """The derivative of ln gamma for x > 0: six steps up, then the asymptotic series."""
    y = x + 6
    i = 1 / (y * y)
    return F.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240))) - (1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5))


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    i = 1 / (y * y)
    return np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240))) - sum(1 / (x + j) for j in range(6))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series six steps up."""
    y = x + 6
    i = 1 / (y * y)
    rise = sum(np.log(x + j) for j in range(6))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - rise


def _parts(of: np.ndarray, words: int | None = None) -> Iterator[tuple[int, int]]:
    """Documents lo to hi of a batch with some _WORDS (or words) words in all, one document at least; of: where each one's words begin, and the end."""
    lo = 0
    while lo < len(of) - 1:
        hi = max(int(np.searchsorted(of, of[lo] + (words or _WORDS), "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def _mixtures(of: np.ndarray, n: np.ndarray, b: np.ndarray, gamma: np.ndarray, alpha: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mixtures, each word's document, documents with words) after some rounds from gamma, for many documents at once; n: counts, b: the topics' weights of each word."""
    row, some = np.repeat(np.arange(len(of) - 1), np.diff(of)), np.flatnonzero(np.diff(of))
    for _ in range(steps):
        theta = np.exp(digamma(gamma))
        gamma = np.tile(alpha, (len(theta), 1))
        if len(some):
            shares = b * (n / (np.einsum("ij,ij->i", theta[row], b) + TINY))[:, None]
            gamma[some] += theta[some] * np.add.reduceat(shares, of[some], axis=0)
    return gamma, row, some


def folded_in(bags: DataFrame, topics: DataFrame, alpha: list[float], steps: int = STEPS, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, probabilities, dominant_topic) of (doc_id, term, n) bags against a fixed topic table, as a fold over `steps` rounds.

    Each round shares out every word by the document's expected log mixture and the topics' weights of it. The start is one for each topic.
    docs: (doc_id), all documents to return, of which those without known terms have the prior's mixture; without it those aren't returned. A
    bag is bounded by the topic table's terms.
    """
    known = bags.join(topics, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("n").cast("double").alias("n"), "weights"))).alias("bag"))
    if docs is not None:
        known = docs.select(F.col("doc_id").alias("_d")).distinct().join(known, F.col("_d").eqNullSafe(F.col("doc_id")), "left").select(F.col("_d").alias("doc_id"), F.coalesce("bag", F.array().cast(known.schema["bag"].dataType)).alias("bag"))
    k, prior = len(alpha), np.array(alpha, float)
    given = known.select("doc_id", F.col("bag.n").alias("n"), F.flatten("bag.weights").alias("weights"))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(given.select("doc_id", F.col("weights").alias("probabilities")).schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ns, weights = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n", "weights"))
            of = np.append(0, np.cumsum(batch.column("n").value_lengths().to_numpy(zero_copy_only=False)))
            gamma = np.ones((batch.num_rows, k))
            for lo, hi in _parts(of):
                part = slice(of[lo], of[hi])
                gamma[lo:hi] = _mixtures(of[lo : hi + 1] - of[lo], ns[part].astype(float), weights.reshape(-1, k)[part].astype(float), gamma[lo:hi], prior, steps)[0]
            made = gamma / gamma.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, k), pa.int32()), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(schema.field("probabilities").type)], schema=schema)

    out = given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, probabilities array<double>")
    return out.withColumn("dominant_topic", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))


def first_topics(vocabulary: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(term_id, weights) to start from: 1 give or take a quarter, by a hash of seed, topic and word; vocabulary: (term_id, term)."""
    share = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("term")), F.lit(1 << 20)) / float(1 << 20)
    return vocabulary.select("term_id", F.array(*[share(i) * 0.5 + 0.75 for i in range(k)]).alias("weights"))


def documents(bags: DataFrame, k: int) -> DataFrame:
    """(doc_id, terms, counts, gamma) of (doc_id, term_id, n) bags: terms in order, and the mixture that training starts from."""
    held = F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("t"), F.col("n").cast("int").alias("n"))))
    rows = bags.groupBy("doc_id").agg(held.alias("b"))
    return rows.select("doc_id", F.col("b.t").alias("terms"), F.col("b.n").alias("counts"), F.array_repeat(F.lit(1.0), k).alias("gamma"))


def _gathered(topics: DataFrame, k: int) -> np.ndarray:
    """The topic table as a matrix (topics, terms): k numbers for each term of a vocabulary that the dictionary bounds."""
    t = topics.select("term_id", "weights").toArrow()
    ids = t.column("term_id").to_numpy()
    out = np.ones((k, (ids.max() + 1) if len(ids) else 0))
    out[:, ids] = t.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, k).T if len(ids) else out
    return out


def _inferred(docs: DataFrame, log_beta, alpha: np.ndarray, steps: int) -> DataFrame:  # noqa: ANN001
    """docs with the mixtures after some rounds, a row each, and a task's sums in rows of kind 1 (term, topic, value) and 2 (place, value): expected counts; bound, documents and expected log mixtures."""
    k = len(alpha)
    fields = docs.schema
    kind = fields["doc_id"].dataType.simpleString()
    out_schema = f"kind int, {_STATE.format(kind)}, term_id int, topic int, value double"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out_schema).schema)
    names = [f.name for f in schema]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = log_beta.value
        stats, sums, beta = np.zeros_like(held), np.zeros(2 + k), np.exp(held)
        for batch in it:
            terms, counts, gammas = (batch.column(c) for c in ("terms", "counts", "gamma"))
            of = np.append(0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)))
            ids, ns = terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False).astype(float)
            made = gammas.flatten().to_numpy(zero_copy_only=False).reshape(-1, k).copy()
            for lo, hi in _parts(of):
                part = slice(of[lo], of[hi])
                w, n, b = ids[part], ns[part], beta[:, ids[part]].T
                gamma, row, _ = _mixtures(of[lo : hi + 1] - of[lo], n, b, made[lo:hi], alpha, steps)
                made[lo:hi] = gamma
                expected = digamma(gamma) - digamma(gamma.sum(1, keepdims=True))
                each = np.exp(expected)[row] * b
                norm = each.sum(1) + TINY
                for i in range(k):
                    stats[i] += np.bincount(w, each[:, i] * (n / norm), stats.shape[1])
                own = ((alpha - gamma) * expected + log_gamma(gamma) - log_gamma(alpha)).sum() + (log_gamma(alpha.sum()) - log_gamma(gamma.sum(1))).sum()
                sums[0] += n @ np.log(norm) + own
                sums[2:] += expected.sum(0)
            n = batch.num_rows
            sums[1] += n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(made.reshape(-1)))
            nothing = [pa.nulls(n, schema.field(c).type) for c in ("term_id", "topic", "value")]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), terms, counts, lists, *nothing], names=names)
        for number, (topic, term, value) in ((1, (*(some := np.nonzero(stats)), stats[some])), (2, (np.arange(2 + k), np.zeros(2 + k, int), sums))):
            for lo in range(0, len(value), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                n = len(value[part])
                nothing = [pa.nulls(n, schema.field(c).type) for c in ("doc_id", "terms", "counts", "gamma")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), *nothing, pa.array(term[part].astype(np.int32)), pa.array(topic[part].astype(np.int32)), pa.array(value[part])], names=names)

    return docs.select("doc_id", "terms", "counts", "gamma").mapInArrow(run, out_schema)


def _topic_bound(weights: np.ndarray, eta: float) -> float:
    """The topics' share of the evidence bound."""
    total = weights.sum(1, keepdims=True)
    expected = digamma(weights) - digamma(total)
    own = ((eta - weights) * expected + log_gamma(weights) - log_gamma(np.array(eta))).sum()
    return float(own + (log_gamma(np.array(eta * weights.shape[1])) - log_gamma(total)).sum())


def learned_prior(alpha: np.ndarray, expected: np.ndarray, n: int, rounds: int = 20) -> np.ndarray:
    """The prior after Newton steps on its share of the bound, of n documents' summed expected log mixtures; a step that would lower it is halved."""
    share = lambda a: n * (log_gamma(a.sum()) - log_gamma(a).sum()) + (a - 1) @ expected
    trigamma = lambda x: 1 / (x + 6) + 0.5 / (x + 6) ** 2 + (1 / 6 - (1 / 30 - 1 / 42 / (x + 6) ** 2) / (x + 6) ** 2) / (x + 6) ** 3 + sum(1 / (x + j) ** 2 for j in range(6))
    for _ in range(rounds):
        gradient = n * (digamma(alpha.sum()) - digamma(alpha)) + expected
        z, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
        change = (gradient - (gradient / q).sum() / (1 / z + (1 / q).sum())) / q
        size = 1.0
        while size > 1e-6 and ((new := alpha - size * change) <= 0).any() | (share(np.maximum(new, 1e-9)) < share(alpha)):
            size /= 2
        if size <= 1e-6:
            break
        alpha = new
    return alpha


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def train(docs: DataFrame, start: DataFrame, path: str, passes: int, alpha: list[float], eta: float, learn_prior: bool = False, steps: int = PASS_STEPS) -> None:
    """Passes of batch variational Bayes over all documents, each written under path; passes that are there already aren't made again.

    docs: `documents`; start: `first_topics` or any other (term_id, weights). A pass writes docs, topics and, last, passes with
    its bound and the prior of the next. The bound can't fall: documents go on from their own mixtures, and each step is the best one given the rest.
    """
    spark, k = docs.sparkSession, len(alpha)
    held = _STATE.format(docs.schema["doc_id"].dataType.simpleString()) + ", term_id int, topic int, value double, kind int"
    if not _exists(spark, f"{path}/docs/0/_SUCCESS"):
        docs.withColumn("kind", F.lit(0)).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/docs/0")
    if not _exists(spark, f"{path}/topics/0/_SUCCESS"):
        start.select(F.col("term_id").cast("int").alias("term_id"), "weights").write.mode("overwrite").parquet(f"{path}/topics/0")
    for p in range(1, passes + 1):
        if _exists(spark, f"{path}/passes/pass={p}/_SUCCESS"):
            continue
        prior = np.array(alpha if p == 1 else spark.read.parquet(f"{path}/passes/pass={p - 1}").first()["alpha"], float)
        before = spark.read.parquet(f"{path}/topics/{p - 1}")
        weights = _gathered(before, k)
        log_beta = spark.sparkContext.broadcast(digamma(weights) - digamma(weights.sum(1, keepdims=True)))
        state = spark.read.schema(held).parquet(f"{path}/docs/{p - 1}").where("kind = 0")
        _inferred(state, log_beta, prior, steps).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/docs/{p}")
        log_beta.unpersist()
        made = spark.read.schema(held).parquet(f"{path}/docs/{p}")
        sums = made.where("kind = 1").groupBy("term_id", "topic").agg(F.sum(F.col("value").cast(_EXACT)).cast("double").alias("value"))
        by_term = sums.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "value"))).alias("held"))
        after = before.select("term_id").join(by_term, "term_id", "left").select("term_id", F.array(*[F.coalesce(F.try_element_at("held", F.lit(i)), F.lit(0.0)) + eta for i in range(k)]).alias("weights"))
        after.write.mode("overwrite").parquet(f"{path}/topics/{p}")
        totals = {r["topic"]: float(r["value"]) for r in made.where("kind = 2").groupBy("topic").agg(F.sum(F.col("value").cast(_EXACT)).alias("value")).collect()}
        n = round(totals.get(1, 0.0))
        bound = totals.get(0, 0.0) + _topic_bound(weights, eta)
        if learn_prior and n:
            prior = learned_prior(prior, np.array([totals[i + 2] for i in range(k)]), n)
        spark.createDataFrame([(bound, n, [float(a) for a in prior])], "bound double, n_docs long, alpha array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/passes/pass={p}")


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """(pass, bound, n_docs, alpha) of the passes that are done."""
    return spark.read.parquet(f"{path}/passes")


def trained_topics(spark: SparkSession, path: str, last: int) -> DataFrame:
    """(term_id, weights): the topics after a pass, each one's weights adding up to 1."""
    t = spark.read.parquet(f"{path}/topics/{last}")
    k = len(t.first()["weights"])
    total = t.agg(*[F.sum(F.col("weights")[i].cast(_EXACT)).cast("double").alias(f"_{i}") for i in range(k)])
    return t.crossJoin(F.broadcast(total)).select("term_id", F.array(*[F.col("weights")[i] / F.col(f"_{i}") for i in range(k)]).alias("weights"))
