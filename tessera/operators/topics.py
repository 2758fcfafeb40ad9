"""Topic models: corpus preparation, LDA, top terms, distributions, coherence and stability."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from . import passes
from .scoring import stored

EPS = 1e-12
#: Tokens of the documents that a task of a coherence measure looks at, more or less.
_TOKENS = 2_000_000
log = logging.getLogger(__name__)


def topic_tokens(clean: DataFrame, stop_words: list[str] = vocab.TOPIC_STOP_WORDS) -> DataFrame:
    """(doc_id, tokens) of (doc_id, clean_text): the words of each document in order that are no stop-words."""
    kept = T.words(F.col("clean_text"))
    return clean.select("doc_id", (F.filter(kept, lambda x: ~x.isin(list(stop_words))) if stop_words else kept).alias("tokens"))


def prepared(clean: DataFrame, stop_words: list[str] = vocab.TOPIC_STOP_WORDS, min_df: int = 5, max_df: float = 0.85, most: int = 100_000) -> tuple[DataFrame, CountVectorizerModel]:
    """((doc_id, tokens, features), dictionary) of (doc_id, clean_text): words in at least min_df documents and at most max_df of them.

    A model's dictionary has the `most` most frequent of them, which bounds its matrices; `words_of` has all. Tokens are stored in
    the shared folder, so that texts are cut once, and the words are counted by Spark; only the model's dictionary is gathered.
    """
    toks = stored(topic_tokens(clean, stop_words), "topic-tokens")
    words = _limited(_frequencies(toks), toks, min_df, max_df)
    held = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]  # bounded by `most`
    if not held:
        raise ValueError("no word is in enough documents for a dictionary")
    model = CountVectorizerModel.from_vocabulary(held, "tokens", "features")
    return model.transform(toks), model


def _frequencies(toks: DataFrame) -> DataFrame:
    """(word, n, df) of (doc_id, tokens): occurrences, and rows that hold the word. A batch of rows is counted at once, so only its distinct words are shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            tokens = batch.column("tokens")
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            coded = tokens.flatten().dictionary_encode()
            ids, v = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            row, ids = row[ids >= 0], ids[ids >= 0]
            held = np.unique(row * v + ids) % v if v else ids
            yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(np.bincount(x, minlength=v)) for x in (ids, held)]], names=["word", "n", "df"])

    counted = toks.select("tokens").mapInArrow(run, "word string, n long, df long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _limited(words: DataFrame, toks: DataFrame, min_df: float, max_df: float) -> DataFrame:
    """Words in at least min_df and at most max_df documents; values under 1, and a max_df of 1.0, are shares of all."""
    n = toks.agg(F.count("*").alias("_all"))
    limit = lambda x, share: F.col("_all") * x if share else F.lit(float(x))
    low, high = limit(min_df, min_df < 1), limit(max_df, max_df < 1 or isinstance(max_df, float) and max_df == 1.0)
    return words.crossJoin(F.broadcast(n)).where((F.col("df") >= low) & (F.col("df") <= high)).drop("_all")


def words_of(toks: DataFrame, min_df: int = 5, max_df: float = 0.85) -> DataFrame:
    """(word, df) of (doc_id, tokens): all words in at least min_df documents and at most max_df of them, however many; df counts doc_ids, max_df is of all rows."""
    df = document_frequency(toks.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")), "word")
    return _limited(df, toks, min_df, max_df).select("word", "df")


def document_frequency(toks: DataFrame, token: str = "token") -> DataFrame:
    return toks.groupBy(token).agg(F.count_distinct("doc_id").alias("df"))


def bag_of_words(toks: DataFrame, token: str = "token") -> DataFrame:
    return toks.groupBy("doc_id", token).agg(F.count("*").alias("n"))


def dictionary(rows: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """(word_id, word, df) of a fitted dictionary."""
    words = rows.sparkSession.createDataFrame(list(enumerate(model.vocabulary)), "word_id int, word string")
    df = document_frequency(rows.select("doc_id", F.explode("tokens").alias("word")), "word")
    return words.join(df, "word").select("word_id", "word", "df")


def fit(rows: DataFrame, k: int, alpha: str | float = "auto", seed: int = 0, max_iter: int = 50, cached: bool = False) -> LDAModel:
    """Online LDA; alpha 'auto' learns the document concentration. Each of the max_iter iterations draws as many rows as there are, with replacement, as the library does. cached: rows are held already."""
    lda = LDA(k=k, optimizer="online", maxIter=max_iter, subsamplingRate=1.0, seed=seed, featuresCol="features", optimizeDocConcentration=alpha == "auto")
    lda = lda if alpha == "auto" else lda.setDocConcentration([float(alpha)])
    if cached:
        return lda.fit(rows.select("features"))
    features = rows.select("features").persist()
    try:
        return lda.fit(features)
    finally:
        features.unpersist()


def top_terms(model: LDAModel, dictionary_model: CountVectorizerModel, n: int = 20) -> DataFrame:
    """(topic_id, rank, term, weight), n terms of each topic."""
    words = F.array(*[F.lit(w) for w in dictionary_model.vocabulary]) if len(dictionary_model.vocabulary) <= 200 else None
    described = model.describeTopics(n).select(F.col("topic").alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    if words is not None:
        return described.select("topic_id", F.col("rank") + 1, F.get(words, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight")).toDF("topic_id", "rank", "term", "weight")
    table = described.sparkSession.createDataFrame(list(enumerate(dictionary_model.vocabulary)), "id int, term string")
    return described.join(table, F.col("t.termIndices") == F.col("id")).select("topic_id", (F.col("rank") + 1).alias("rank"), "term", F.col("t.termWeights").alias("weight"))


def document_topics(model: LDAModel, rows: DataFrame) -> DataFrame:
    """(doc_id, probabilities, dominant_topic): the first of equal greatest probabilities is dominant."""
    out = model.transform(rows).select("doc_id", vector_to_array("topicDistribution").alias("probabilities"))
    return out.withColumn("dominant_topic", dominant(F.col("probabilities")))


def dominant(probabilities: F.Column) -> F.Column:
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def wide(doc_topics: DataFrame, k: int) -> DataFrame:
    """One column for each topic."""
    return doc_topics.select("doc_id", "dominant_topic", *[F.get("probabilities", F.lit(i)).alias(f"Topic_{i}") for i in range(k)])


def keywords_table(terms: DataFrame) -> DataFrame:
    """(Topic_ID, Keywords): 'word (weight), …' by rank."""
    piece = F.struct("rank", F.concat("term", F.lit(" ("), F.round("weight", 3).cast("string"), F.lit(")")).alias("t"))
    return terms.groupBy(F.col("topic_id").alias("Topic_ID")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), ", ").alias("Keywords"))


def _covered(toks: DataFrame, words: DataFrame, window: int | None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, term, spans), (total)): stretches (s, e) of starts of the windows in which a word occurs, (0, 0) for whole documents; total counts all windows.

    Only topic words are looked at. A document shorter than the window is one window. The windows of an
    occurrence begin at its place or up to window - 1 before; touching stretches are one. Rows are dealt by doc_id to
    as many partitions as there are _TOKENS of tokens, so that what a task sorts doesn't grow with the input.
    """
    sizes = stored(toks.groupBy("doc_id").agg(F.count("*").alias("n")), "document-sizes")
    last = F.greatest(F.col("n") - (window or 0), F.lit(0)) if window else F.lit(0)
    total = sizes.agg(F.sum(last + 1).cast("double").alias("total"))
    parts = -(-(sizes.agg(F.sum("n")).first()[0] or 0) // _TOKENS) + 1
    hits = toks.join(F.broadcast(words), toks["token"] == words["term"], "left_semi").repartition(parts, "doc_id").join(sizes.repartition(parts, "doc_id").hint("merge"), "doc_id")  # words: a few for each topic
    low, high = (F.greatest(F.col("place") - (window - 1), F.lit(0)), F.least(F.col("place"), last)) if window else (F.lit(0), F.lit(0))
    hits = hits.select("doc_id", F.col("token").alias("term"), low.cast("long").alias("s"), high.cast("long").alias("e"))
    order = Window.partitionBy("doc_id", "term").orderBy("s", "e")
    new = hits.withColumn("new", F.coalesce(F.col("s") > F.lag("e").over(order) + 1, F.lit(True)).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "term", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans")), total


def _length(spans: F.Column) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"] + 1)


def _overlap(a: F.Column, b: F.Column) -> F.Column:
    """Numbers in both of two lists of ascending stretches, in one walk over both."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("n"))

    def step(at: F.Column, _: F.Column) -> F.Column:
        x, y = F.get(a, at["i"]), F.get(b, at["j"])
        both = F.greatest(F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]) + 1, F.lit(0).cast("long"))
        ends = (x["e"] <= y["e"]).cast("int")
        return F.struct(F.coalesce(at["i"] + ends, at["i"]).alias("i"), F.coalesce(at["j"] + 1 - ends, at["j"]).alias("j"), (at["n"] + F.coalesce(F.when(x.isNotNull() & y.isNotNull(), both), F.lit(0).cast("long"))).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, step)["n"]


def pair_counts(toks: DataFrame, topics: DataFrame, window: int | None) -> DataFrame:
    """(topic_id, i, j, wi, wj, ni, nj, nij, total) of each ordered pair of a topic's words, equal ones too; counts are of windows.

    toks: (doc_id, place, token), place from 0 without gaps; topics: (topic_id, rank, term).
    """
    seen, total = _covered(toks, topics.select("term").distinct(), window)
    a, b = topics.select("topic_id", F.col("rank").alias("i"), F.col("term").alias("wi")), topics.select("topic_id", F.col("rank").alias("j"), F.col("term").alias("wj"))
    pairs = a.join(b, "topic_id")
    placed = seen.join(F.broadcast(topics.select("topic_id", "term").distinct()), "term")  # a few words for each topic
    held = placed.groupBy("doc_id", "topic_id").agg(F.collect_list(F.struct("term", "spans")).alias("held"))  # a topic's words of a document
    each = held.select("topic_id", "held", F.explode("held").alias("x")).select("topic_id", "x", F.explode(F.filter("held", lambda y: F.col("x.term") <= y["term"])).alias("y"))
    counted = each.groupBy("topic_id", F.col("x.term").alias("wi"), F.col("y.term").alias("wj")).agg(F.sum(_overlap(F.col("x.spans"), F.col("y.spans"))).cast("double").alias("nij"))
    one_way = stored(counted, "pair-counts")
    single = one_way.where("wi = wj").groupBy(F.col("wi").alias("term")).agg(F.max("nij").alias("n"))  # a word's windows are those it shares with itself, in each of its topics
    both = one_way.union(one_way.where("wi <> wj").select("topic_id", F.col("wj").alias("wi"), F.col("wi").alias("wj"), "nij"))
    out = pairs.join(both, ["topic_id", "wi", "wj"], "left").join(single.select(F.col("term").alias("wi"), F.col("n").alias("ni")), "wi", "left").join(single.select(F.col("term").alias("wj"), F.col("n").alias("nj")), "wj", "left").crossJoin(F.broadcast(total))
    return out.na.fill(0.0, ["ni", "nj", "nij"])


def u_mass(toks: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, u_mass): mean over pairs i > j of ln((D(wi, wj) / N + eps) / (D(wj) / N)), document counts."""
    p = pair_counts(toks, topics, None).where("i > j and nj > 0")
    return p.groupBy("topic_id").agg(F.avg(F.log((F.col("nij") / F.col("total") + EPS) / (F.col("nj") / F.col("total")))).alias("u_mass"))


def _npmi() -> F.Column:
    pij, pi, pj = F.col("nij") / F.col("total"), F.col("ni") / F.col("total"), F.col("nj") / F.col("total")
    return F.when((pi > 0) & (pj > 0), F.log((pij + EPS) / (pi * pj)) / -F.log(pij + EPS)).otherwise(0.0)


def c_npmi(toks: DataFrame, topics: DataFrame, window: int = 10) -> DataFrame:
    """(topic_id, c_npmi): mean normalised pointwise mutual information of ordered pairs over sliding windows."""
    return pair_counts(toks, topics, window).where("i <> j").groupBy("topic_id").agg(F.avg(_npmi()).alias("c_npmi"))


def c_v(toks: DataFrame, topics: DataFrame, window: int = 110) -> DataFrame:
    """(topic_id, c_v): mean cosine of each word's vector of normalised information with the sum of all."""
    v = pair_counts(toks, topics, window).withColumn("v", _npmi())
    total = v.groupBy("topic_id", "j").agg(F.sum("v").alias("s"))
    per = v.join(total, ["topic_id", "j"]).groupBy("topic_id", "i").agg((F.sum(F.col("v") * F.col("s")) / F.nullif(F.sqrt(F.sum(F.col("v") ** 2)) * F.sqrt(F.sum(F.col("s") ** 2)), F.lit(0.0))).alias("c"))
    return per.groupBy("topic_id").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("c_v"))


def coherence(toks: DataFrame, topics: DataFrame) -> tuple[float, float, float]:
    """(c_v, u_mass, c_npmi): means over topics, rounded to 4 places; one that fails, or has no topic, is NaN, with a warning."""
    out = []
    for name, measure in (("c_v", c_v), ("u_mass", u_mass), ("c_npmi", c_npmi)):
        try:
            value = measure(toks, topics).agg(F.round(F.avg(name), 4)).first()[0]
        except PySparkException as e:
            log.warning("%s failed: %s", name, e)
            value = None
        out.append(float("nan") if value is None else float(value))
    return tuple(out)


def topic_sets(topics: DataFrame, by: list[str]) -> DataFrame:
    return topics.groupBy(*by).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def pair_jaccard(sets: DataFrame, key: str) -> DataFrame:
    """(a, b, jaccard) of each pair of keys a < b; sets are topics, a few hundred at most."""
    a, b = sets.select(F.col(key).alias("a"), F.col("terms").alias("x")), sets.select(F.col(key).alias("b"), F.col("terms").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("jaccard"))


def aligned(a: F.Column, b: F.Column) -> F.Column:
    """Greedy alignment of two arrays of word arrays, as a fold over a: the state is what is left of b and the sum so far.

    Each topic of a takes the most similar one left, that of the lowest place among equal ones; the sum goes over the topics of a, 0 without any.
    """
    places = F.transform(b, lambda _, j: j)
    start = F.struct(places.alias("left"), F.lit(0.0).alias("total"))

    def step(state: F.Column, words: F.Column) -> F.Column:
        scores = F.transform(state["left"], lambda j: F.struct(T.jaccard(words, F.get(b, j)).alias("score"), (-j).alias("place")))
        taken = lambda best: F.struct(F.filter(state["left"], lambda j: F.coalesce(j + best["place"] != 0, F.lit(True))).alias("left"), (state["total"] + F.coalesce(best["score"], F.lit(0.0))).alias("total"))
        return T.let(F.array_max(scores), taken)

    return F.coalesce(F.aggregate(a, start, step)["total"] / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def stability(topics: DataFrame) -> DataFrame:
    """(mean, std, n_pairs) of the aligned similarity of each pair of models; topics: (model, topic_id, term), a few hundred topics in all."""
    sets = topic_sets(topics, ["model", "topic_id"])
    models = sets.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "terms"))), lambda x: x["terms"]).alias("t"))
    pairs = models.select(F.col("model").alias("a"), F.col("t").alias("x")).join(models.select(F.col("model").alias("b"), F.col("t").alias("y")), F.col("a") < F.col("b"))
    per = pairs.select("a", "b", aligned(F.col("x"), F.col("y")).alias("s"))
    return per.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("std"), F.count("*").alias("n_pairs"))


def compute_stability(rows: DataFrame, dictionary_model: CountVectorizerModel, k: int, seeds: int, n: int = 10, alpha: str | float = "auto", max_iter: int = passes.PASSES, at_once: int = 4) -> DataFrame:
    """stability of models of different seeds, fitted at_once over the same blocks of rows."""
    spark = rows.sparkSession
    if not seeds:
        return stability(spark.createDataFrame([], "model int, topic_id int, term string"))
    with passes.Corpus(rows, dictionary_model) as corpus, ThreadPoolExecutor(max(1, at_once)) as pool:
        models = list(pool.map(inheritable_thread_target(spark)(lambda seed: corpus.fit(k, alpha, seed, max_iter)), range(seeds)))
    terms = [passes.top_terms(m, spark, n).select(F.lit(seed).alias("model"), "topic_id", "term") for seed, m in enumerate(models)]
    return stability(reduce(DataFrame.union, terms))


def ranked_terms(toks: DataFrame, by: str, n: int) -> DataFrame:
    """The n most frequent tokens of each group, ties by token."""
    counts = toks.groupBy(by, "token").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= n)
