"""What the two classifiers share: labelled training rows, batches of scores and the model's way to executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches

#: Most labelled rows that a model is fitted on, those with the least md5(doc_id). Scoring has no limit.
SAMPLE = 6_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod FOLDS is 0; they are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(text, y) of at most `most` labelled rows that aren't held out; conflicting labels of an id are averaged and rounded."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def scored(docs: DataFrame, score, threshold: float, column: str = "text") -> DataFrame:  # noqa: ANN001
    """docs with held_out, score and predicted; score: a function of an Arrow text column to an array, run on executors."""
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = kept.withColumn("score", F.lit(0.0))
    schema = to_arrow_schema(out.schema)

    def run(batch: pa.RecordBatch) -> list:
        return [*(batch.column(i) for i in range(len(names))), np.asarray(score(batch.column(column)), np.float64)]

    bounded_batches(docs.sparkSession)
    made = kept.mapInArrow(batches(run, schema), out.schema)
    return made.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The chance that a row of label 1 scores above one of label 0, ties counting half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    rank = np.empty(len(s))
    rank[order] = (first + last + 1) / 2
    p = (y == 1).sum()
    return float((rank[y == 1].sum() - p * (p + 1) / 2) / max(1, p * (len(y) - p)))


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m, self.v = ([np.zeros_like(p) for p in parameters] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
