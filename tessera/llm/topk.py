"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OUT = "query_id long, vec_id long, score long"


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as a double; null where the vector or a component is null or not finite. A component beyond the range of long is an error."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) < 2.0**63, x.cast("double") * scale).otherwise(F.raise_error(F.lit("a component is beyond the range of long")))).cast("long")
    return F.when(vec.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vec, whole))


def _dense(vectors: pa.ListArray) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _postings(dense: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term (dimension) the rows with a weight other than 0, and those weights."""
    return [(at := np.flatnonzero(dense[:, t]), dense[at, t]) for t in range(dense.shape[1])]


def accumulate(queries: np.ndarray, docs: np.ndarray, block: int = 128):
    """Yields (first query, scores): each term's postings are scattered into a dense score array.

    Scores are exact: where a sum could pass 64 bits it is made of Python's integers.
    """
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    wide = most(queries) * most(docs) * min(queries.shape[1], docs.shape[1]) >= 1 << 63
    kind = object if wide else np.int64
    lists = _postings(docs.astype(kind) if wide else docs)
    for lo in range(0, len(queries), block):
        part = queries[lo : lo + block]
        scores = np.zeros((len(part), len(docs)), kind)
        for (rows, weights), (at, values) in zip(_postings(part.astype(kind) if wide else part), lists, strict=False):
            add = weights[:, None] * values
            if len(at) == len(docs):
                scores[rows] += add
            elif len(at):
                scores[np.ix_(rows, at)] += add
        yield lo, scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores; ids ascend, so that a stable sort gives ties to the smaller id."""
    allowed = np.flatnonzero(ids != own)
    s = scores[allowed]
    if len(s) > k:
        keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        allowed, s = allowed[keep], s[keep]
    return allowed[np.argsort(-s, kind="stable")[:k]]


#: Numbers of one side of a pair of blocks, and pairs of blocks that are wanted at least for each core.
BLOCK_NUMBERS, PAIRS = 1 << 22, 2


def top_k(queries: DataFrame, docs: DataFrame, k: int = 5, doc_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """The k highest inner products for each query: (query_id, rank, vec_id, score), ties to the smaller id.

    Both inputs are (vec_id long, v array<long>); rows with a null id or vector are left out, an empty
    vector scores 0, vectors of unequal length are compared as if padded with zeros. A query isn't
    compared with rows of its own id; equal query rows count once, equal document rows each count. A score
    beyond the range of long is an error. Blocks of queries meet blocks of documents, one task for each
    pair of blocks. A block holds as many rows as memory allows, so that rows are copied to few tasks, but
    no more than give each core some pairs; each pair returns at most k rows for a query, which a window merges.
    """
    docs = docs.where("vec_id is not null and v is not null").select("vec_id", "v")
    queries = queries.where("vec_id is not null and v is not null").select("vec_id", "v").distinct()
    (n, width), (m, wide) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for df in (docs, queries))
    most = max(1, BLOCK_NUMBERS // max(1, width, wide))
    n_queries = max(1, -(-m // (query_block or most)))
    n_docs = max(1, -(-n // (doc_block or most)))
    if doc_block is None:
        n_docs = max(n_docs, min(-(-PAIRS * docs.sparkSession.sparkContext.defaultParallelism // n_queries), -(-n // 1024), 1 << 20), 1)
    spread = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumns({mine: F.col(mine).cast("int"), other: F.col(other).cast("int")})
    q = spread(queries, "qb", n_queries, "db", n_docs)
    d = spread(docs, "db", n_docs, "qb", n_queries)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        flat = lambda t: _dense(t["v"].combine_chunks())
        ids, own = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        qs, vs, ss = [], [], []
        for lo, scores in accumulate(flat(left), flat(right)) if len(ids) and len(own) else ():
            for i, row in enumerate(scores):
                at = best(row, ids, own[lo + i], k)
                qs.append(np.full(len(at), own[lo + i]))
                vs.append(ids[at])
                ss.append(row[at].astype(np.int64))  # raises beyond the range of long
        cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"query_id": cat(qs), "vec_id": cat(vs), "score": cat(ss)})

    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(meet, _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
