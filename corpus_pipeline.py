"""The corpus pipeline: documents without toxic texts, near duplicates and benchmark passages, mixed and as token ids.

Null texts count as empty: they aren't toxic nor contaminated, are near duplicates of each other, are
taken 0 times by the mix. Rows that repeat a doc_id are one document for near duplicates; rows with a null
doc_id aren't compared and stay. Extra columns go along. Empty tables give empty results.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the rows that it
keeps, with the columns of documents; the last returns doc_id, start, n_tokens and ids_crc32.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, minhash, mixing, tokenfile, toxicity
from tessera.llm.common import load, release, stored
from tessera.llm.queries import word_count


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of docs that aren't held out; rows that score 0.5 or more go."""
    model = toxicity.train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    own = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes
    scored = toxicity.classified(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()]), model)
    return scored.where("predicted = 0").select(*[F.col(a).alias(c) for c, a in own.items()])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class stays."""
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay as they are."""
    return decontam.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order: those the mix takes twice come twice, those it doesn't take go."""
    return mixing.mixed(docs, word_count())


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files in the order of the mix, that of the files and rows that docs is read from, and returns what was read back from them.

    Rows that aren't read from files have no such order and are written by doc_id.
    """
    order = [tokenfile.file_place(), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return tokenfile.token_output(docs, tokenizer())
    return tokenfile.token_output(docs, tokenizer(), order)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("mixing", mixed), ("token_output", as_tokens)]

#: Trained models, connected components and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
