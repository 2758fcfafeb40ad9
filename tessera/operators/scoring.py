"""Component scores, standardised composite indices and labels. Everything is keyed by doc_id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def _term_counts(text: Column, terms: list[str]) -> Column:
    """How often each of the terms occurs, as an array in their order.

    The hits of one alternation become lines, and a term's count is what removing its lines takes off the length.
    """
    pattern = r"\b(?:" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b"
    hits = T.found(F.lower(text), pattern)
    joined = F.concat(F.lit("\n"), F.array_join(hits, "\n\n"), F.lit("\n"))  # a line for each hit, so that a term is counted without a loop
    count = lambda held, t: ((F.length(held) - F.length(F.replace(held, F.lit(f"\n{t}\n"), F.lit("")))) / (len(t) + 2)).cast("int")
    return T.let(joined, lambda held: F.array(*[count(held, t) for t in terms]))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its splits are fewer, as those of a small file are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str = "components") -> DataFrame:
    """df as a table in the shared folder, so that what is worked out of texts is worked out once."""
    from ..sources.sinks import scratch

    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distinct(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))


def with_breadth(df: DataFrame, counts: str, out: str = "sus") -> DataFrame:
    """df with the mean over the terms of the length-normalised tf-idf vector, by smooth idf ln((1 + N) / (1 + df)) + 1; counts: _term_counts.

    The only thing gathered is one row with the documents of each term, so rows stay where they are; null and repeated doc_ids are rows like others.
    """
    n = df.select(F.posexplode(counts).alias("k", "c")).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("c") > 0).alias("df"))
    idf = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))), lambda x: x["idf"]).alias("_idf"))  # a number for each term
    v = F.zip_with(counts, "_idf", lambda c, i: c * i)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    score = T.let(v, lambda v: F.when(total(v) > 0, total(v) / F.sqrt(total(F.transform(v, lambda x: x * x))) / F.size(v)).otherwise(0.0))
    return df.crossJoin(F.broadcast(idf)).withColumn(out, F.coalesce(score, F.lit(0.0))).drop("_idf")


def breadth(docs: DataFrame, terms: list[str] = vocab.TERMS) -> DataFrame:
    """(doc_id, sus) of with_breadth; documents without hits score 0 and count in N."""
    terms = _distinct(terms)
    held = spread(docs.select("doc_id", "text")).select("doc_id", F.coalesce(_term_counts(F.col("text"), terms), F.array_repeat(F.lit(0), len(terms))).alias("_tf"))
    return with_breadth(stored(held), "_tf").select("doc_id", "sus")


def _polarity(text: Column, positive: list[str], negative: list[str], stem: bool, stop_words: list[str] = ()) -> Column:
    """(P - N) / (P + N + 1e-6) over the words of the two lists that aren't stop-words, or over their stems, made once for each word of a Python worker."""
    if not stem:
        n = lambda held, xs: F.size(F.filter(held, lambda x: x.isin(xs) & ~x.isin(list(stop_words)) if stop_words else x.isin(xs)))
        both = T.let(T.found(F.lower(text), "[a-z]+"), lambda held: F.struct(n(held, positive).alias("p"), n(held, negative).alias("n")))
        return F.coalesce(T.let(both, lambda x: (x["p"] - x["n"]) / (x["p"] + x["n"] + 1e-6)), F.lit(0.0))
    from .lexical import porter_stem

    stop = set(stop_words)
    plus, minus = ({porter_stem(x) for x in xs} for xs in (positive, negative))

    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        from functools import lru_cache

        stems = lru_cache(1 << 16)(porter_stem)

        def one(held):  # noqa: ANN001, ANN202
            found = [stems(w) for w in (held if held is not None else ()) if w not in stop]
            p, n = sum(x in plus for x in found), sum(x in minus for x in found)
            return (p - n) / (p + n + 1e-6)

        return words.map(one).astype(float)

    return score(T.found(F.lower(F.coalesce(text, F.lit(""))), "[a-z]+"))


def polarity(docs: DataFrame, positive: list[str], negative: list[str], stem: bool = False, stop_words: list[str] = ()) -> DataFrame:
    """(doc_id, sen): (P - N) / (P + N + 1e-6) over the text's words of the two lists, or over their stems; a null text scores 0."""
    return spread(docs.select("doc_id", "text")).select("doc_id", _polarity(F.col("text"), positive, negative, stem, stop_words).alias("sen"))


def _quant(text: Column, patterns: dict[str, str]) -> Column:
    n = sum((T.count(text, f"(?i){p}") for p in patterns.values()), F.lit(0))
    return F.coalesce(n / F.greatest(F.size(T.words(text)), F.lit(1)), F.lit(0.0))


def _hedge(text: Column, words: list[str]) -> Column:
    return F.coalesce(T.let(T.words(text), lambda parts: F.size(F.filter(parts, lambda x: F.lower(x).isin(words))) / F.greatest(F.size(parts), F.lit(1))), F.lit(0.0))


def quant(docs: DataFrame, patterns: dict[str, str] = vocab.QUANT_PATTERNS) -> DataFrame:
    """(doc_id, quant): matches of all patterns, without regard to case, per word."""
    return docs.select("doc_id", _quant(F.col("text"), patterns).alias("quant"))


def hedge(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hedge): share of the words that are in the list."""
    return docs.select("doc_id", _hedge(F.col("text"), words).alias("hedge"))


def hedge_words(lexicon: DataFrame, categories: list[str] = vocab.HEDGE_CATEGORIES) -> list[str]:
    """Distinct lower-case words of a lexicon's (word, sentiment) categories; a lexicon is a dictionary, and fits the driver."""
    return [r[0] for r in lexicon.where(F.col("sentiment").isin(categories)).select(F.lower("word").alias("w")).distinct().orderBy("w").collect()]


def zscores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """scores with z_<column>, by population deviation, 0 where that is 0: one aggregate row, no window over all."""
    stats = scores.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = scores.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return out.drop(*stats.columns)


def indexed(scores: DataFrame, w_quant: float = vocab.W_QUANT, w_hedge: float = vocab.W_HEDGE, flagged: str = vocab.FLAGGED, genuine: str = vocab.GENUINE) -> DataFrame:
    """scores (sus, sen, quant, hedge) with idx, idx_ext and their labels: flagged over 0, genuine else."""
    z = zscores(scores, ["sus", "sen", "quant", "hedge"])
    out = z.withColumn("idx", F.col("z_sen") - F.col("z_sus")).withColumn("idx_ext", F.col("z_sen") - F.col("z_sus") - w_quant * F.col("z_quant") + w_hedge * F.col("z_hedge"))
    label = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), flagged).otherwise(genuine)
    return out.withColumn("label", label("idx")).withColumn("label_ext", label("idx_ext")).drop("z_sus", "z_sen", "z_quant", "z_hedge")


def flag_summary(scores: DataFrame) -> DataFrame:
    """Documents, and those over 0 in either index after rounding to 4 places."""
    over = lambda c: F.count_if((F.round(c, 4) > 0) & ~F.isnan(c))
    return scores.agg(F.count("*").alias("n_docs"), over("idx").alias("n_flagged"), over("idx_ext").alias("n_flagged_ext"))


def with_components(docs: DataFrame, terms: list[str], positive: list[str], negative: list[str], hedges: list[str], patterns: dict[str, str] = vocab.QUANT_PATTERNS, stem: bool = False, text: str = "text", stop_words: list[str] = (), keep_text: bool = True) -> DataFrame:
    """docs with sus, sen, quant and hedge of a text column, which is read once: what each text gives is stored, and documents of terms are counted in that.

    stop_words don't count in polarity. Without keep_text the text column goes.
    """
    terms = _distinct(terms)
    col = F.col(text)
    tf = F.coalesce(_term_counts(col, terms), F.array_repeat(F.lit(0), len(terms)))
    parts = spread(docs).withColumns({"_tf": tf, "sen": _polarity(col, positive, negative, stem, stop_words), "quant": _quant(col, patterns), "hedge": _hedge(col, hedges)})
    return with_breadth(stored(parts if keep_text else parts.drop(text)), "_tf").drop("_tf")


def scored(docs: DataFrame, terms: list[str], positive: list[str], negative: list[str], hedges: list[str], patterns: dict[str, str] = vocab.QUANT_PATTERNS, stem: bool = False, stop_words: list[str] = ()) -> DataFrame:
    """All components and indices of (doc_id, text) documents, a row for each of them."""
    return indexed(with_components(docs.select("doc_id", "text"), terms, positive, negative, hedges, patterns, stem, stop_words=stop_words, keep_text=False))
