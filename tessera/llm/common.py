"""Shared pieces: shared-folder tables, word hashing over Arrow buffers and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that are part of a word: digits and letters; every byte from 0x80 up is too.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: SQL twin of the word class, for lower-cased text.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 1 << 20
#: Words of 64 bits in a bitmap of ids that is broadcast, 16 MB at most.
_SLOTS = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Without one, a local master gets a temporary folder; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again, and has the driver collect garbage, as Spark only deletes shuffle files of finished steps once their plans are collected."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._stored_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    tables[0].sparkSession._jvm.System.gc()


def among(rows: DataFrame, key: str, ids: DataFrame, held: str) -> DataFrame:
    """The rows whose key is among the `held` of ids, and few others: a bitmap of hashed ids, of _SLOTS words of 64 bits at most, is broadcast."""
    mark = lambda c: F.xxhash64(F.lit(1), c)
    slot = lambda c: F.pmod(mark(c), F.lit(_SLOTS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(mark(c), 32), F.lit(64)).cast("int"))
    marks = ids.groupBy(slot(held).alias("_slot")).agg(F.bit_or(bit(held)).alias("_word"))
    some = rows.withColumn("_slot", slot(key)).join(F.broadcast(marks), "_slot").where(F.col("_word").bitwiseAND(bit(key)) != 0)
    return some.drop("_slot", "_word")


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lowers the session's bytes of an Arrow batch to `size`, where it is higher or not set: texts may be long. It changes no result."""
    held = spark.conf.get(_BYTES, None)
    if held is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) <= size:
        spark.conf.set(_BYTES, str(size))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty), or those of a large binary one, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of byte spans in ascending order, and of their first bytes, of each length in prefixes.

    A polynomial of the bytes, as a difference of running sums; spans are taken some megabyte at a time.
    """
    out = np.zeros((1 + len(prefixes), len(starts)), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _CHUNK, "right")))
        at = starts[lo]
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        part = raw[at : ends[hi - 1]]
        power, back = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        for i, to in enumerate((e, *(np.minimum(s + k, e) for k in prefixes))):
            out[i, lo:hi] = mix((total[to] - total[s]) * back[s])
        lo = hi
    return list(out)


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if n > len(_held[0]):
        for i, x in enumerate((_P, _P_INV)):
            p = np.full(n, x)
            p[0] = 1
            whole = np.multiply.accumulate(p)
            if n > 4 * _CHUNK:  # a very long span's powers aren't kept
                if i:
                    return [first, whole]
                first = whole
            else:
                _held[i] = whole
    return [p[:n] for p in _held]


class Words:
    """Words of a batch of texts: byte spans, 64-bit hashes and the range of words of each row.

    prefixes: lengths in bytes; prefix[k] holds the hash of each word's first bytes, of the whole word if it is shorter.
    is_word: the bytes that are part of a word.
    """

    def __init__(self, col: pa.Array, prefixes: tuple[int, ...] = (), is_word: np.ndarray = IS_WORD):
        raw, self.rows = text_buffer(col)
        self.raw = raw
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = is_word[raw]
        first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = np.unique(self.rows)
        inner = inner[(inner > 0) & (inner < len(raw))]
        first[inner], last[inner - 1] = word[1:-1][inner], word[1:-1][inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes, *more = span_hashes(LOWER[raw], self.starts, self.ends, prefixes)
        self.prefix = dict(zip(prefixes, more, strict=True))
        self.of_row = np.searchsorted(self.starts, self.rows)

    def row(self, i: int) -> np.ndarray:
        return self.hashes[self.of_row[i] : self.of_row[i + 1]]

    def word(self, k: int) -> str:
        return LOWER[self.raw[self.starts[k] : self.ends[k]]].tobytes().decode("utf-8", "replace")

    def __len__(self) -> int:
        return len(self.rows) - 1


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter, not empty text is one run."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j]
    return mix(out)


def batches(of, schema: pa.Schema):
    """A mapInArrow function from one that turns a RecordBatch into lists of columns or an array each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(of(batch), schema, strict=True)], schema=schema)

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of (a, b) links: rows (id, class_id), class_id the least id; ids without links are left out.

    Large-star and small-star rounds over DataFrames; each round's edges are stored in the shared
    folder. A star's edges are built with a grouped minimum and a join, never by gathering a group.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # a plain table, so that a hub's edges can be split in the join
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small, "edges")
        release(edges, least)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())
