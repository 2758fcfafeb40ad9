"""The four stages, each of which can be left out: extraction, preprocessing, scoring and topics."""

from __future__ import annotations

import logging

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import grid, lexical, metadata, scoring, topics
from ..operators import zones as Z
from ..sources import readers, sinks

log = logging.getLogger(__name__)


def extract(blocks: DataFrame, pages: DataFrame, keywords: str | None = None, **options) -> DataFrame:
    """Zones of page blocks."""
    return Z.zones(Z.paragraphs(Z.units(blocks, pages, keywords)), keywords, **options)


def preprocess(texts: DataFrame, dim: DataFrame | None = None, stop_words: list[str] | None = None, lemmas: DataFrame | None = None, unseen: bool = False) -> DataFrame:
    """(doc_id, document, country, company, year, doc_type, clean_text) of (doc_id, path, relevant_text) rows; empty texts go. stop_words: None for common English ones. unseen: see kept_tokens."""
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    named = readers.with_path_parts(texts.where("relevant_text <> ''"))
    clean = lexical.clean_text(lexical.kept_tokens(lexical.tokens(named.select("doc_id", F.col("relevant_text").alias("text"))), stop_words, lemmas, unseen=unseen))
    out = named.join(clean, "doc_id").withColumn("year", T.year_of_name(F.col("document"))).where("clean_text <> ''")
    out = metadata.with_doc_type(out, dim) if dim is not None else out.withColumn("doc_type", F.lit("Unknown"))
    return out.select("doc_id", "document", "country", "company", "year", "doc_type", "clean_text")


def reloaded(spark: SparkSession, path: str, dim: DataFrame | None = None) -> DataFrame:
    """A corpus file with year and document type made again; a name without a year keeps the year of the file."""
    stored = readers.corpus(spark, path).withColumn("doc_id", F.concat_ws("/", "country", "company", "document"))
    year = T.year_of_name(F.col("document"))
    stored = stored.withColumn("year", F.when(year == "N/A", F.coalesce("year", F.lit("N/A"))).otherwise(year))
    return metadata.with_doc_type(stored, dim) if dim is not None else stored.withColumn("doc_type", F.coalesce("doc_type", F.lit("Unknown")))


def score(corpus: DataFrame, positive: list[str], negative: list[str], hedges: list[str], terms: list[str] = vocab.TERMS, stem: bool = True, quant_source: DataFrame | None = None, polarity_stop_words: list[str] = ()) -> DataFrame:
    """corpus with components, indices and labels. quant_source: (doc_id, text) of raw texts, as clean ones hold no numbers."""
    out = scoring.with_components(corpus, terms, positive, negative, hedges, stem=stem, text="clean_text", stop_words=polarity_stop_words)
    if quant_source is not None:
        out = out.drop("quant").join(scoring.quant(quant_source), "doc_id", "left").fillna(0.0, ["quant"])
    return scoring.indexed(out)


def run(spark: SparkSession, out: str, *, blocks: DataFrame | None = None, pages: DataFrame | None = None, zone_root: str | None = None, corpus_path: str | None = None, dim: DataFrame | None = None, positive: list[str] = (), negative: list[str] = (), hedges: list[str] = (), stop_words: list[str] | None = None, keywords: str | None = None, run_extraction: bool = True, run_preproc: bool = True, run_scoring: bool = True, run_topics: bool = False, topic_options: dict | None = None) -> DataFrame | None:
    """Runs the chosen stages and writes their files under out; returns the scores, or the corpus without scoring.

    blocks' doc_id is a file path. Without extraction, zone files are read from zone_root; without
    preprocessing, the corpus from corpus_path, and year and document type are made again. Topic models that an earlier run
    left under out aren't fitted again.
    """
    corpus = None
    if run_preproc:
        if run_extraction:
            if blocks is None or pages is None:
                raise ValueError("extraction needs blocks and pages")
            zone = extract(blocks, pages, keywords)
            files = readers.with_path_parts(blocks.select("doc_id").distinct().withColumn("path", F.col("doc_id")))
            sinks.zones(zone, files, f"{out}/chunks_lexical")
            texts = Z.relevant_text(zone).withColumn("path", F.col("doc_id"))
        else:
            texts = readers.zone_files(spark, zone_root).select(F.col("path").alias("doc_id"), "path", "relevant_text")
        corpus = preprocess(texts.select("doc_id", "path", "relevant_text"), dim, stop_words)
        sinks.corpus(corpus, f"{out}/processed_texts.csv")
    elif corpus_path:
        corpus = reloaded(spark, corpus_path, dim)
    if corpus is None:
        log.info("nothing to do without preprocessing or a corpus")
        return None
    scores = None
    if run_scoring:
        scores = score(corpus, list(positive), list(negative), list(hedges))
        sinks.results(scores, f"{out}/results.csv")
    if run_topics:
        options = topic_options or {}
        rows, words = topics.prepared(corpus, min_df=options.get("min_df", 5), max_df=options.get("max_df", 0.85))
        toks = rows.select("doc_id", F.posexplode("tokens").alias("place", "token"))
        tables = f"{out}/topics/tables"

        def save(key, model) -> None:  # noqa: ANN001
            k, alpha, n = key
            folder = sinks.run_folder(f"{out}/topics", alpha, k, n)
            sinks.topic_keywords(grid.model_table(spark, tables, "topics", key), f"{folder}/lda_topics_keywords.csv")
            sinks.document_distribution(grid.model_table(spark, tables, "mixtures", key), corpus.select("doc_id", "document"), k, f"{folder}/lda_document_distribution.csv")
            sinks.dictionary(topics.dictionary(rows, words), f"{folder}/dictionary_readable.txt")
            sinks.model(model, f"{folder}/model")
            sinks.model(words, f"{folder}/dictionary")

        chosen = {name: options[name] for name in ("counts", "alphas", "runs", "max_iter", "at_once") if name in options}
        table = grid.run(rows, words, toks, tables, save=save, **chosen)
        if not table.isEmpty():
            sinks.coherence(table, f"{out}/coherence.csv")
    return scores if scores is not None else corpus
