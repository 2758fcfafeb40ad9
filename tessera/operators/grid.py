"""A grid of topic models, several fitted at a time, that goes on where it was broken off."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from . import topics

Key = tuple[int, str, int]
_BY = ["alpha", "num_topics", "iter"]
_TOPICS = "topic_id int, rank int, term string, weight double"
_COHERENCE = "c_v double, u_mass double, c_npmi double, alpha string, num_topics int, iter int"


def _write(df: DataFrame, path: str, key: Key) -> None:
    """Writes the partition of a model; those of other models stay."""
    k, alpha, run = key
    placed = df.withColumns({"alpha": F.lit(alpha), "num_topics": F.lit(k), "iter": F.lit(run)})
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_BY).parquet(path)


def coherence(spark: SparkSession, path: str) -> DataFrame:
    """(num_topics, alpha, iter, c_v, u_mass, c_npmi) of the models that are done."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/coherence")
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], _COHERENCE).select(*_BY[1::-1], "iter", "c_v", "u_mass", "c_npmi")
    return spark.read.schema(_COHERENCE).parquet(f"{path}/coherence").select(*_BY[1::-1], "iter", "c_v", "u_mass", "c_npmi")


def model_table(spark: SparkSession, path: str, name: str, key: Key) -> DataFrame:
    """The rows of a model in the table `topics` or `mixtures`; a dictionary without words gives no topics."""
    k, alpha, run = key
    read = spark.read.schema(f"{_TOPICS}, alpha string, num_topics int, iter int") if name == "topics" else spark.read
    return read.parquet(f"{path}/{name}").where((F.col("num_topics") == k) & (F.col("alpha").cast("string") == alpha) & (F.col("iter") == run)).drop(*_BY)


def run(rows: DataFrame, dictionary_model: CountVectorizerModel, toks: DataFrame, path: str, counts: tuple = vocab.TOPIC_COUNTS, alphas: tuple = vocab.TOPIC_ALPHAS, runs: int = vocab.TOPIC_RUNS, max_iter: int = 50, at_once: int = 4, save: Callable[[Key, LDAModel], None] | None = None) -> DataFrame:
    """Fits the models of the grid that path doesn't hold yet and returns `coherence` of all; run is the seed, from 1.

    `at_once` models are fitted over one cached table of features, each in a scheduler pool of its own, so that with
    spark.scheduler.mode=FAIR they share the executors evenly. The tables topics (topic_id, rank, term, weight), mixtures
    (doc_id, probabilities, dominant_topic) and coherence are partitioned by alpha, num_topics and iter. A model is done when its row of
    coherence, the last thing written, is there; save is called before. When a model fails, those that run are finished, then the error is raised.
    """
    spark = rows.sparkSession
    done = {(r["num_topics"], r["alpha"], r["iter"]) for r in coherence(spark, path).collect()}  # a row for each model
    wanted = [(k, str(alpha), n) for k, alpha, n in product(counts, alphas, range(1, runs + 1))]
    todo = sorted((key for key in wanted if key not in done), key=lambda key: -key[0])  # the longest first
    rows, toks, failed = rows.persist(), toks.persist(), Event()

    def one(key: Key) -> None:
        if failed.is_set():
            return
        try:
            fitted(key)
        except BaseException:
            failed.set()
            raise

    def fitted(key: Key) -> None:
        k, alpha, n = key
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"topics_{alpha}_{k}_{n}")
        model = topics.fit(rows, k, alpha if alpha == "auto" else float(alpha), n, max_iter, cached=True)
        terms = topics.top_terms(model, dictionary_model)
        _write(terms, f"{path}/topics", key)
        _write(topics.document_topics(model, rows), f"{path}/mixtures", key)
        if save is not None:
            save(key, model)
        held = spark.createDataFrame([topics.coherence(toks, terms)], "c_v double, u_mass double, c_npmi double")
        _write(held.coalesce(1), f"{path}/coherence", key)

    try:
        if todo:
            rows.count(), toks.count()  # cached once, before the models begin
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            started = [pool.submit(inheritable_thread_target(spark)(one), key) for key in todo]
        for f in started:
            f.result()
    finally:
        rows.unpersist()
        toks.unpersist()
    return coherence(spark, path)
