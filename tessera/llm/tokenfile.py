"""Token ids in Parquet list columns: delta encoding, controlled row groups and pages, selective reads."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, bounded_batches, shared_dir, span_hashes, text_buffer

END_ID = 2
#: Parquet writer: version 2 pages and no dictionary give DELTA_BINARY_PACKED ids; column and offset indexes are always written.
WRITER = {"maxRecordsPerFile": "0", "compression": "snappy", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000"}
_SCHEMA = "doc_id long, n_tokens long, ids array<int>"
#: Kinds of bytes: control characters and spaces, printed ASCII other than letters, letters, and beyond ASCII.
_LETTER, _PRINTED, _BEYOND = 2, 1, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _PRINTED
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:] = _BEYOND


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library, each different piece of text once.

    The known pattern of byte-level files always begins a new token after an ASCII letter that something else in
    ASCII follows, before a space that a printable ASCII character follows, and after a line feed
    between a printable ASCII character and an ASCII letter. Texts are cut there, so that the ids of a text are those of its pieces. The
    library encodes pieces that are new; their ids are kept by 64-bit hash in a table of a fixed size,
    which is emptied when it is half full. Texts of a file with another pattern, or with a normaliser, are
    encoded whole, and so are texts that hold the string of a special token, which becomes that token's id; plain=True takes it as ordinary text.
    """

    BITS = 22

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.special = [] if plain else [t["content"].encode() for t in held.get("added_tokens") or []]
        before = held.get("pre_tokenizer") or {}
        self.known = not held.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.places = np.zeros(1 << self.BITS, np.int32)
        self.ids = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros((1 << (self.BITS - 1)) + 2, np.int64)
        self.n = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place among the pieces, -1 if it is new."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            held = self.keys[slot[todo]]
            same = held == h[todo]
            out[todo[same]] = self.places[slot[todo[same]]]
            todo = todo[~same & (held != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
        return out

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces, whose hashes differ and are new."""
        todo = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(todo):
            free = self.keys[slot[todo]] == 0
            _, first = np.unique(slot[todo], return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= free
            self.keys[slot[todo[mine]]] = h[todo[mine]]
            self.places[slot[todo[mine]]] = self.n + todo[mine]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
        for lo in range(0, len(pieces), 2048):
            made = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 2048], add_special_tokens=False)]
            ends = self.starts[self.n] + np.cumsum([len(x) for x in made])
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.starts[self.n] : ends[-1]] = np.fromiter(chain.from_iterable(made), np.int32)
            self.starts[self.n + 1 : self.n + 1 + len(made)] = ends
            self.n += len(made)

    def _cut(self, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
        kind = _KIND[raw]
        before, here = kind[:-1], kind[1:]
        edge = np.zeros(len(raw), bool)
        edge[1:] = (before == _LETTER) & (here != _LETTER) & (here != _BEYOND)
        edge[2:] |= (raw[1:-1] == 0x0A) & (here[1:] == _LETTER) & ((before[:-1] == _LETTER) | (before[:-1] == _PRINTED))
        edge[:-1] |= (raw[:-1] == 0x20) & ((here == _LETTER) | (here == _PRINTED))
        text = raw.tobytes() if self.special else b""
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                row = np.searchsorted(rows, at, "right")
                edge[rows[row - 1] : rows[row]] = False
                at = text.find(token, rows[row])
        edge[rows[:-1][rows[:-1] < len(raw)]] = True
        return np.flatnonzero(edge)

    def encode(self, col: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the offsets of each row's ids in them; end_id follows each row."""
        raw, rows = text_buffer(col)
        if not self.known:
            made = [e.ids + ([] if end_id is None else [end_id]) for e in self.tokenizer.encode_batch_fast(col.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(made), np.int32), np.cumsum([0, *map(len, made)])
        starts = self._cut(raw, rows) if len(raw) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        parts, sizes = [], np.zeros(len(starts), np.int64)
        most = 1 << (self.BITS - 2)  # so that the table holds all new pieces of a part
        for lo in range(0, len(starts), most):
            hi = min(lo + most, len(starts))
            got, sizes[lo:hi] = self._encode(raw, starts[lo:hi], ends[lo:hi])
            parts.append(got)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, rows)]
        if end_id is not None:
            ids = np.insert(ids, upto[1:], end_id)
            upto = upto + np.arange(len(upto))
        return ids, upto

    def _encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (h,) = span_hashes(raw, starts, ends)
        h[h == 0] = 1
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            own, first = np.unique(h[new], return_index=True)
            if self.n + len(own) > 1 << (self.BITS - 1):
                self._clear()
                own, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
            first = new[first]
            self._learn(own, [raw[a:b].tobytes().decode() for a, b in zip(starts[first], ends[first], strict=True)])
            at[new] = self._find(h[new])
        size = self.starts[at + 1] - self.starts[at]
        total = np.cumsum(size)
        return self.ids[np.repeat(self.starts[at] - total + size, size) + np.arange(total[-1])], size


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves one task after another."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, order: list[Column] | None = None) -> None:
    """Writes (doc_id, n_tokens, ids) in ascending doc_id order, or in that of the columns given, file after file: a range shuffle, then a sort in each file.

    A null text is empty (its end id alone); a null doc_id comes first; rows of equal doc_id stand in
    order of a hash of their text, by which many of them can go to several files.
    """
    bounded_batches(docs.sparkSession)

    def encode(batch: pa.RecordBatch) -> list:
        ids, offsets = encoder(tokenizer_path).encode(batch.column("text"), end_id)
        return [batch.column("doc_id"), np.diff(offsets), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    keys = [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))] if order is None else order
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = docs.select(*[k.alias(n) for n, k in zip(names, keys, strict=True)], F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    ordered.mapInArrow(batches(encode, schema), _SCHEMA).write.options(**WRITER).parquet(path)


def file_place() -> Column:
    """The place of a row's Parquet file among those of its folder: a task's number, then, where it was told to begin a new file after some rows, the file's."""
    name = F.col("_metadata.file_name")
    part, split = (F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0)) for pattern in (r"^part-(\d+)", r"-c(\d+)\."))
    return part * (1 << 32) + split


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, file, row): file is the place of the file, row that of the row in it.

    Selecting columns reads those columns alone; a filter on doc_id skips row groups and pages.
    """
    return spark.read.schema(_SCHEMA).parquet(path).select("*", file_place().alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """rows of read_tokens with start, the ids of all rows before: sums of whole files (of sizes, or rows itself), then of a file's rows."""
    files = (rows if sizes is None else sizes).groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_n").over(before(Window.orderBy("file"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("file").orderBy("row"))), F.lit(0))
    return rows.withColumn("_in", inside).join(files, "file").withColumn("start", F.col("_before") + F.col("_in")).drop("_in", "_before")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of read_tokens, from the ids that were read."""

    def crc(batch: pa.RecordBatch) -> list:
        ids = batch.column("ids")
        flat, offsets = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        return [batch.column("doc_id"), np.diff(offsets), [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)], batch.column("file"), batch.column("row")]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.int64()), ("row", pa.int64())])
    bounded_batches(rows.sparkSession)
    found = rows.select("doc_id", "ids", "file", "row").mapInArrow(batches(crc, schema), "doc_id long, n_tokens long, ids_crc32 long, file long, row long")
    return with_starts(found, rows.select("file", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, order: list[Column] | None = None) -> DataFrame:
    """Writes docs' ids in the shared folder and returns the digest of what was read back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, order=order)
    return digest(read_tokens(docs.sparkSession, path))
