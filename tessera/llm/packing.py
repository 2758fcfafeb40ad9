"""Sequences of bounded length packed from documents by bulk-synchronous best fit.

Documents longer than a sequence are cut; a piece of more than half a sequence opens one. The rest are placed in rounds: free
pieces and gaps are range-sorted by size, a sweep over each range gives a gap the largest piece below it that is left, and
what is left of it the next one; gaps that found nothing in their range take pieces of lower ranges by rank, so that
no piece is given twice. Then gaps are updated, and the next round begins. New sequences open when the gaps can't hold the rest.

A null text is empty and has its end id alone; repeated rows are packed as often as they come, a null doc_id is kept, other columns are
ignored, no rows give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, stored
from .tokenfile import encoder

CAPACITY, END_ID = 2048, 0
#: Pieces and gaps of a range, about.
RANGE_ROWS = 1 << 16
#: Kinds of rows of a sweep: a placed piece, a piece and a gap that found nothing, a gap that took something.
_PLACED, _PIECE, _GAP, _TOOK = range(4)
_SWEPT = "kind int, id long, size long, seq long, offset long, part int, rank long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id, doc_id, piece, start, length, ids_crc32) of (doc_id, text): ids of the text and the end id, cut from the end into pieces of `capacity`; the first may be shorter."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batch: pa.RecordBatch) -> list:
        ids, upto = encoder(tokenizer_path).encode(batch.column("text"), end_id)
        n = np.diff(upto)
        times = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), times)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        short = n - (times - 1) * capacity
        start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, short[row])
        at = upto[row] + start
        flat = ids.astype("<u4")
        crc = [zlib.crc32(flat[a : a + k].tobytes()) for a, k in zip(at, length, strict=True)]
        held = [batch.column("doc_id").take(pa.array(row)), piece, start, length, crc]
        return held + [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids, pa.int32()))] * keep_ids

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = texts.mapInArrow(batches(cut, schema), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    return made.withColumn("id", F.monotonically_increasing_id())


def _sweep(capacity: int):  # noqa: ANN202
    """A mapInArrow function over a range's (size, is_gap, id) rows in ascending order, pieces before gaps of their size."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("size", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sizes: list[int] = []  # pieces so far, ascending
        ids: list[int] = []
        left: list[int] = []  # the last free piece up to a place, a link at a time; place 0 stands for none
        out: list[tuple] = []
        waiting = 0

        def last_free(k: int) -> int:
            end = k
            while left[end] != end:
                end = left[end]
            while left[k] != end:
                left[k], k = end, left[k]
            return end

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        left.append(0)
        for batch in it:
            for size, is_gap, key in zip(*(batch.column(c).to_pylist() for c in ("size", "is_gap", "id")), strict=True):
                if not is_gap:
                    sizes.append(size)
                    ids.append(key)
                    left.append(len(sizes))
                    continue
                free = size
                while free and (k := last_free(bisect_right(sizes, free))):
                    out.append((_PLACED, ids[k - 1], sizes[k - 1], key, capacity - free, part, None))
                    free -= sizes[k - 1]
                    left[k] = k - 1
                if free == size:
                    out.append((_GAP, key, free, None, None, part, waiting))
                    waiting += 1
                elif free:
                    out.append((_TOOK, key, free, None, None, part, None))
            if out:
                yield made()
                out = []
        k, rank = last_free(len(sizes)), 0
        while k:
            out.append((_PIECE, ids[k - 1], sizes[k - 1], None, None, part, rank))
            k, rank = last_free(k - 1), rank + 1
        if out:
            yield made()

    return run


def _met(counts: dict[int, dict[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (gap part, first gap rank, piece part, first piece rank, length): gaps of a range, smallest first, take the largest pieces left of the nearest lower ranges."""
    stretches, free = [], []
    for part in sorted(counts):
        gaps, at = counts[part].get(_GAP, 0), 0
        while at < gaps and free:
            of, rank, n = free.pop()
            m = min(n, gaps - at)
            stretches.append((part, at, of, rank, m))
            at += m
            if m < n:
                free.append((of, rank + m, n - m))
        if counts[part].get(_PIECE, 0):
            free.append((part, 0, counts[part][_PIECE]))
    return stretches


def packed(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, sequence_id, offset) of (id, size) rows with distinct ids from 0 and sizes of 1 to capacity. Each round's rows are stored in the shared folder."""
    spark = items.sparkSession
    openers = items.where(F.col("size") * 2 > capacity)
    done = [openers.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = openers.where(F.col("size") < capacity).select(F.col("id"), (capacity - F.col("size")).alias("size"))
    free = items.where(F.col("size") * 2 <= capacity).select("id", "size")
    opened = 0
    while True:
        both = free.withColumn("is_gap", F.lit(False)).union(gaps.withColumn("is_gap", F.lit(True)))
        sizes = both.groupBy("is_gap", "size").count().collect()  # two rows for each size up to capacity
        own = {r["size"]: r["count"] for r in sizes if not r["is_gap"]}
        if not own:
            return reduce(DataFrame.union, done)
        room = {r["size"]: r["count"] for r in sizes if r["is_gap"] and r["size"] >= min(own)}
        gaps = gaps.where(F.col("size") >= min(own))
        new = max(0, -(-(sum(k * n for k, n in own.items()) - sum(k * n for k, n in room.items())) // capacity))
        if new:
            gaps = gaps.union(spark.range(new).select((-F.col("id") - 1 - opened).alias("id"), F.lit(capacity).cast("long").alias("size")))
            opened += new
        both = free.withColumn("is_gap", F.lit(False)).union(gaps.withColumn("is_gap", F.lit(True)))
        by = ["size", "is_gap", F.xxhash64("id"), "id"]
        ranges = -(-(sum(own.values()) + sum(room.values()) + new) // range_rows)
        ranged = both.coalesce(1) if ranges == 1 else both.repartitionByRange(ranges, *by)  # a single range needs no exchange
        swept = stored(ranged.sortWithinPartitions(*by).select("size", "is_gap", "id").mapInArrow(_sweep(capacity), _SWEPT), "swept")
        counts: dict[int, dict[int, int]] = {}
        for r in swept.where(F.col("kind").isin(_PIECE, _GAP)).groupBy("part", "kind").count().collect():  # two rows for each range
            counts.setdefault(r["part"], {})[r["kind"]] = r["count"]
        done.append(swept.where(F.col("kind") == _PLACED).select("id", F.col("seq").alias("sequence_id"), "offset"))
        of = lambda kind: swept.where(F.col("kind") == kind).select("id", "size", "part", "rank")
        took = swept.where(F.col("kind") == _TOOK).select("id", "size")
        if not (stretches := _met(counts)):
            free, gaps = of(_PIECE).select("id", "size"), of(_GAP).select("id", "size").union(took)
            continue
        held = spark.createDataFrame([(i, *x) for i, x in enumerate(stretches)], "_k long, _gap int, _g long, _piece int, _p long, _n long")  # at most two for each range

        def dealt(rows: DataFrame, part: str, first: str) -> DataFrame:
            inside = (F.col("part") == F.col(part)) & (F.col("rank") >= F.col(first)) & (F.col("rank") < F.col(first) + F.col("_n"))
            return rows.join(F.broadcast(held.select("_k", part, first, "_n")), inside, "left").select("id", "size", "_k", (F.col("rank") - F.col(first)).alias("_i"))

        of_pieces, of_gaps = dealt(of(_PIECE), "_piece", "_p"), dealt(of(_GAP), "_gap", "_g")
        pairs = of_pieces.where("_k is not null").join(of_gaps.where("_k is not null").select(F.col("id").alias("sequence_id"), F.col("size").alias("room"), "_k", "_i"), ["_k", "_i"])
        pairs = stored(pairs.select("id", "sequence_id", (capacity - F.col("room")).alias("offset"), (F.col("room") - F.col("size")).alias("room")), "pairs")
        done.append(pairs.select("id", "sequence_id", "offset"))
        free = of_pieces.where("_k is null").select("id", "size")
        gaps = of_gaps.where("_k is null").select("id", "size").union(took).union(pairs.select(F.col("sequence_id").alias("id"), F.col("room").alias("size")))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of (doc_id, text) documents, a row for each piece."""
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    places = packed(cut.select("id", F.col("length").alias("size")), capacity)
    return cut.join(places, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, `capacity` ids at most."""
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, True), "pieces")
    places = packed(cut.select("id", F.col("length").alias("size")), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of a bounded sequence
    return cut.select("id", "ids").join(places, "id").groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
