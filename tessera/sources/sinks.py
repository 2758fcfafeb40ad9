"""Writers of zones, corpora, results and topic models, with the fixed column headers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


#: For writes of very many files to a new folder: tasks put theirs in place, where the driver would move one after the other at the end.
PARALLEL_COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a file's round trip: in the shared folder of spark.checkpoint.dir, or a temporary one of a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("escape", '"').csv(path)


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(c) for a, c in names.items()])


def zones(zone: DataFrame, files: DataFrame, path: str) -> None:
    """A JSON file for each document with zones, under path at the place that mirrors the document's own; files: (doc_id, document, path)."""
    from . import zonefiles

    held = F.struct("text", "start_char", "end_char", "source", "section", "kw_count", "keywords_found", "word_count", "kw_density")
    per = zone.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_char", held.alias("z")))), lambda x: x["z"]).alias("zones"))
    out = per.withColumn("relevant_text", F.array_join(F.transform("zones", lambda z: z["text"]), "\n\n\n\n")).join(files, "doc_id")
    zonefiles.register(zone.sparkSession)
    rows = out.select(T.zone_path(F.col("path")).alias("zone_path"), F.col("document").alias("file"), "path", "zones", "relevant_text")
    rows.write.format(zonefiles.FORMAT).mode("overwrite").save(path)


def corpus(df: DataFrame, path: str) -> None:
    _csv(_named(df.where("clean_text <> ''"), vocab.CORPUS_COLUMNS), path)


def results(df: DataFrame, path: str, columns: dict[str, str] = vocab.RESULT_COLUMNS) -> None:
    numbers = ("sus", "sen", "quant", "hedge", "idx", "idx_ext")
    _csv(_named(df.withColumns({c: F.round(c, 4) for c in numbers}), columns), path)


def topic_keywords(terms: DataFrame, path: str) -> None:
    from ..operators.topics import keywords_table

    _csv(keywords_table(terms).orderBy("Topic_ID"), path)


def document_distribution(doc_topics: DataFrame, documents: DataFrame, k: int, path: str) -> None:
    """documents: (doc_id, document)."""
    from ..operators.topics import wide

    _csv(wide(doc_topics, k).join(documents, "doc_id").select(F.col("document").alias("Documento"), F.col("dominant_topic").alias("Dominant_Topic"), *[f"Topic_{i}" for i in range(k)]), path)


def dictionary(df: DataFrame, path: str) -> None:
    df.select("word_id", "word", "df").write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def coherence(df: DataFrame, path: str) -> None:
    _csv(_named(df, vocab.COHERENCE_COLUMNS), path)


def model(fitted, path: str) -> None:  # noqa: ANN001
    fitted.write().overwrite().save(path)


def run_folder(root: str, alpha: str | float, k: int, run: int) -> str:
    return f"{root}/alpha_{alpha}_n_topics_{k}_k_{run}"
