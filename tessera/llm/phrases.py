"""Collocations of two to five words, mined by pivot partitioning.

Every occurrence of a phrase belongs to one place of the text, the leftmost of its rarest word (the pivot). A place is
routed as a fragment: its word, up to four more frequent words to the left and up to four words to the right
that are no rarer; infrequent words and the ends of a piece cut fragments. A bucket holds all fragments of its
pivots, so it counts their phrases alone. A pivot of many fragments is dealt to several buckets, whose counts are added up.

Texts that are null count as empty, a null language as `und`; other columns are ignored, repeated rows count each time,
empty tables give no rows. Words are told apart by 62 bits of a hash of language and word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, bounded_batches, mix, stored

#: Least occurrences of a phrase, most words of it, most phrases of a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A candidate goes if a longer one around it has this share of its occurrences, in per cent.
ABSORBED = 100
#: Words of the broadcast dictionary (16 bytes each), the most frequent ones; fragments of the others are routed by hash.
LISTED = 1 << 20
#: Fragments of a bucket, about; a pivot that occurs more often than half of it is dealt to several.
BUCKET = 1 << 18
#: Distinct words, and words of fragments, that a task gathers before it passes them on.
_GATHERED = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_IN_WORD = ~_BREAK
_IN_WORD[[0x20, 0x09]] = False


def language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


class Pieces:
    """Words of a batch of texts with the number of their piece, from 0, and a 62-bit hash of language and word."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        w = Words(text, is_word=_IN_WORD)
        row = np.repeat(np.arange(len(w)), np.diff(w.of_row))
        breaks = np.cumsum(_BREAK[w.raw], dtype=np.int32)
        at = breaks[w.starts]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
        self.piece = np.cumsum(new) - 1
        coded = lang.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[row]
        self.hashes = (mix(w.hashes ^ salt[self.lang]) >> np.uint64(2)).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        self.words = w

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at some places, in lower case."""
        starts, sizes = self.words.starts[at], self.words.ends[at] - self.words.starts[at]
        ends = np.cumsum(sizes)
        flat = LOWER[self.words.raw[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat)])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n) of all words; the row of null word holds a language's total. Counts are added up in tasks first."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.large_binary()), ("h", pa.int64()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            got = pa.concat_tables(held).group_by(["lang", "word", "h"], use_threads=False).aggregate([("n", "sum")])
            return got.rename_columns(["lang", "word", "h", "n"])

        for batch in it:
            p = Pieces(batch.column("text"), batch.column("lang"))
            h, first, n = np.unique(p.hashes, return_index=True, return_counts=True)
            names = pa.array(p.names, pa.string())
            total = np.bincount(p.lang, minlength=len(p.names)) if len(h) else np.zeros(len(p.names), np.int64)
            held.append(pa.table([names, pa.nulls(len(names), pa.large_binary()), np.zeros(len(names), np.int64), total], schema=schema))
            held.append(pa.table([names.take(pa.array(p.lang[first])), p.spelled(first), h, n], schema=schema))
            if sum(t.num_rows for t in held) > _GATHERED:
                held = [summed()]
                if held[0].num_rows > _GATHERED // 2:
                    yield from held[0].cast(schema).to_batches(max_chunksize=1 << 15)
                    held = []
        if held:
            yield from summed().cast(schema).to_batches(max_chunksize=1 << 15)

    bounded_batches(docs.sparkSession)
    each = docs.select(language().alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "lang string, word binary, h long, n long")
    return each.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


@dataclass
class Dictionary:
    """The most frequent words by hash and by rank, 0 the most frequent; a word that isn't listed ranks after them by its hash.

    complete: no other word is frequent. dealt: how many buckets a pivot is dealt to, by rank.
    """

    sorted_hashes: np.ndarray
    ranks: np.ndarray
    hashes: np.ndarray
    dealt: np.ndarray
    complete: bool

    RARE = np.iinfo(np.int64).max

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.RARE)
        at = np.minimum(np.searchsorted(self.sorted_hashes, hashes), len(self.hashes) - 1)
        other = self.RARE if self.complete else hashes + len(self.hashes)
        return np.where(self.sorted_hashes[at] == hashes, self.ranks[at], other)

    def hashed(self, ranks: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        return np.where(ranks < n, self.hashes[np.minimum(ranks, n - 1)], ranks - n) if n else ranks

    def times(self, ranks: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        return np.where(ranks < n, self.dealt[np.minimum(ranks, n - 1)], 1) if n else np.ones(len(ranks), np.int64)


def dictionary(frequent: DataFrame, listed: int = LISTED, bucket: int = BUCKET) -> Dictionary:
    """Of (h, n, …) rows of frequent words: at most `listed` of them are gathered."""
    top = frequent.orderBy(F.desc("n"), "h").limit(listed + 1).select("h", "n").toArrow()
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    complete = len(h) <= listed
    h, n = h[:listed], n[:listed]
    order = np.argsort(h)
    return Dictionary(h[order], order.astype(np.int64), h, -(-n // max(1, bucket // 2)), complete)


def fragments(docs: DataFrame, words, buckets: int, longest: int = LONGEST) -> DataFrame:  # noqa: ANN001
    """(bucket, shapes, ids): fragments of a bucket from some texts; shapes is a byte each (words to the left and right of the pivot), ids are ranks."""
    schema = pa.schema([("bucket", pa.int64()), ("shapes", pa.binary()), ("ids", pa.binary())])
    reach, rare = longest - 1, Dictionary.RARE

    def cut(ranks: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
        r = np.full(2 * reach + len(ranks) + (piece[-1] if len(piece) else 0), rare)
        r[reach + piece + np.arange(len(ranks))] = ranks  # one rare word stands between pieces
        at = np.flatnonzero(r != rare)
        own = r[at]
        sides = []
        for step, fits in ((-1, np.less), (1, np.less_equal)):
            still, n = np.ones(len(at), bool), np.zeros(len(at), np.int64)
            for j in range(1, reach + 1):
                still = still & fits(r[at + step * j], own)
                n += still
            sides.append(n)
        some = sides[0] + sides[1] > 0
        at, left, right = at[some], sides[0][some], sides[1][some]
        salt = at % words.value.times(r[at])
        bucket = (mix(r[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, left, right, bucket = at[order], left[order], right[order], bucket[order]
        size = left + right + 1
        ends = np.cumsum(size)
        ids = r[np.repeat(at - left - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return bucket, (left << 4 | right).astype(np.uint8), size, ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        kind = np.int32 if words.value.complete else np.int64

        def made() -> Iterator[pa.RecordBatch]:
            ends = np.cumsum([0, *(p[-1] + 1 for _, p in held)])
            bucket, shapes, size, ids = cut(np.concatenate([r for r, _ in held]), np.concatenate([p + e for (_, p), e in zip(held, ends, strict=False)]))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            upto = np.append(0, np.cumsum(size))
            last = np.append(first[1:], len(bucket))
            for lo in range(0, len(first), 256):
                a, b = first[lo : lo + 256], last[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a]), pa.array([shapes[x:y].tobytes() for x, y in zip(a, b, strict=True)]), pa.array([ids[upto[x] : upto[y]].astype(kind).tobytes() for x, y in zip(a, b, strict=True)])], schema=schema)

        for batch in it:
            p = Pieces(batch.column("text"), batch.column("lang"))
            if len(p.hashes):
                held.append((words.value.rank(p.hashes), p.piece))
                n += len(p.hashes)
            if n >= _GATHERED:
                yield from made()
                held, n = [], 0
        if held:
            yield from made()

    bounded_batches(docs.sparkSession)
    texts = docs.select(language().alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "bucket long, shapes binary, ids binary")


def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the first of each distinct row of a matrix, how often each occurs, and each row's number among the distinct ones."""
    h = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64) + np.uint64(1))
    _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if not np.array_equal(rows[first][which], rows):  # rows that differ met in a hash
        _, first, which, n = np.unique(rows, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, n, which.reshape(-1)


def mined(cuts: DataFrame, words, least: int = LEAST, longest: int = LONGEST) -> DataFrame:  # noqa: ANN001
    """(g, n): phrases as arrays of word hashes, counted by bucket; infrequent ones only come from pivots that are dealt to several buckets."""
    schema = pa.schema([("g", pa.list_(pa.int64())), ("n", pa.int64())])

    def mine(table: pa.Table) -> pa.Table:
        kind = np.int32 if words.value.complete else np.int64
        shapes = np.frombuffer(b"".join(table.column("shapes").to_pylist()), np.uint8).astype(np.int64)
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), kind).astype(np.int64)
        left, right = shapes >> 4, shapes & 15
        size = left + right + 1
        centre = np.cumsum(size) - size + left
        open_ = words.value.times(ids[centre]) > 1
        alive: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for n in range(2, longest + 1):
            parts, rows = [], []
            for a in range(n):
                b = n - 1 - a
                fits = (left >= a) & (right >= b)
                for part, there in (((a - 1, b), a > 0 and n > 2), ((a, b - 1), b > 0 and n > 2)):
                    if there:
                        fits &= alive[part]  # a phrase is no more frequent than its parts
                at = np.flatnonzero(fits)
                parts.append((a, b, at))
                rows.append(ids[centre[at][:, None] + np.arange(-a, b + 1)])
            first, times, which = counted(whole := np.concatenate(rows))
            keep = (times >= least) | open_[np.concatenate([at for _, _, at in parts])][first]
            lo = 0
            for a, b, at in parts:
                alive[a, b] = np.zeros(len(shapes), bool)
                alive[a, b][at] = keep[which[lo : lo + len(at)]]
                lo += len(at)
            got = words.value.hashed(whole[first[keep]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, n), pa.int32()), pa.array(got.reshape(-1)))
            out.append(pa.table([lists, pa.array(times[keep])], schema=schema))
        return pa.concat_tables(out)

    each = cuts.groupBy("bucket").applyInArrow(mine, "g array<long>, n long")
    return each.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scored(grams: DataFrame, frequent: DataFrame, totals: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of grams (g, n) that no longer one absorbs; frequent: (lang, word, h, n), totals: (lang, total).

    A longer phrase around one holds one with a single word more, which is no less frequent, so only those are looked at.
    """
    size = F.size("g")
    inner = F.explode(F.array(F.slice("g", F.lit(1), size - 1), F.slice("g", F.lit(2), size - 1)))
    longer = grams.where(size > 2).select(inner.alias("g"), F.col("n").alias("_m")).groupBy("g").agg(F.max("_m").alias("_m"))
    kept = grams.join(longer, "g", "left").where(F.col("_m").isNull() | (F.col("_m") * 100 < F.col("n") * absorbed)).select("g", F.col("n").alias("a"))
    counts = grams.select("g", "n").union(frequent.select(F.array("h").alias("g"), "n"))
    part = lambda g, n: counts.select(F.col("g").alias(g), F.col("n").alias(n))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({"_l": F.slice("g", F.lit(1), F.col("k")), "_r": F.slice("g", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(part("_l", "l"), "_l").join(part("_r", "r"), "_r").select("g", "a", "k", "l", "r")
    spelled = kept.select("g", F.posexplode("g").alias("_i", "h")).join(frequent.select("h", "word", "lang"), "h").groupBy("g")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scores = cuts.join(spelled, "g").join(totals, "lang").withColumn("n", F.col("total"))
    scores = scores.withColumn("score", F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r")))
    best = scores.groupBy("g", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language with their rank: the first of each of 16 shares, then the first of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return first(first(scores.withColumn("_share", share), "lang", "_share").drop("_share"), "lang")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED, listed: int = LISTED, bucket: int = BUCKET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows: phrases whose words occur together oftener than their parts let expect.

    a, l and r are the occurrences of the phrase and of its parts at the cut of the least score, n those of all words.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    frequent, totals = counts.where("word is not null"), counts.where("word is null").select("lang", F.col("n").alias("total"))
    words = spark.sparkContext.broadcast(dictionary(frequent, listed, bucket))
    total = (totals if not words.value.complete else frequent.withColumnRenamed("n", "total")).agg(F.sum("total")).first()[0]
    cuts = fragments(docs, words, max(1, -(-(total or 0) // bucket)), longest)
    grams = stored(mined(cuts, words, least, longest), "grams")
    return ranked(scored(grams, frequent, totals, absorbed), top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
