"""Near-duplicate detection with DartMinHash signatures, bands and exact checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, bounded_batches, components, mix, release, shingles, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates of a signature: BANDS bands of ROWS. At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 24, 3e-6.
ROWS, BANDS = 4, 24
#: Pairs whose signatures agree in a smaller share aren't checked: at similarity 0.8 that is over 5 standard deviations off.
LEAST_AGREEMENT = 0.58
#: Documents whose ids are broadcast at most, to read only their texts; more are joined.
BROADCAST_IDS = 2_000_000
#: Height of the lowest rank region; region l > 0 spans ranks LOWEST * 2 ** (l - 1) to LOWEST * 2 ** l.
_LOW_BITS = 10
#: Regions that are looked at together.
_PART = 1 << 16
#: Texts, and elements of their sets, in one of two blocks that are compared with each other.
BLOCK, BLOCK_ELEMENTS = 512, 1 << 17
_U = np.float64(2.0**-53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _U


def _poisson_cdf(mean: float, n: int = 18) -> np.ndarray:
    p = np.exp(-mean) * np.cumprod(np.concatenate([[1.0], mean / np.arange(1, n)]))
    return np.cumsum(p)


class DartMinHash:
    """Signatures of weighted sets: two sets agree in a coordinate with their weighted Jaccard similarity as probability.

    The plane of an element, weight by rank, is cut into regions whose sides double: weights up to 1, from
    1 to 2, 2 to 4 and so on, by bands of ranks that double in height; a region is cut again along
    the ranks into cells of an area of 1 at most. A cell's hash fixes how many darts fall in it (Poisson)
    and of each dart its weight, rank, coordinate and id, so all sets that hold the element see the
    same darts. A dart counts if its weight lies under the element's. Each coordinate keeps the dart
    of least rank. A set with total weight m only looks at ranks up to about k ln k / m, so the darts
    thrown are k ln k or so for any set; sets that miss a coordinate look one band further.
    """

    def __init__(self, k: int = ROWS * BANDS, seed: int = 1):
        self.k = k
        self.seed = seed
        self.want = k * (np.log(k) + 2)

    def signatures(self, element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """An (n, k) uint32 array. element: hashes; owner: the set (0..n-1) of each; weight: over 0. Sets without elements get 0."""
        best = np.full(n * self.k, np.iinfo(np.uint64).max, np.uint64)
        mass = np.bincount(owner, weight, n)
        full = mass == 0
        need = np.zeros(n, np.int64)
        need[~full] = np.maximum(np.ceil(np.log2(self.want / mass[~full])) + _LOW_BITS, 0)
        level = 0
        open_sets = ~full
        at = np.arange(len(element))
        while open_sets.any():
            at = at[open_sets[owner[at]]]
            strip, held = 0, at
            while len(held):
                self._throw(best, level, strip, element[held], owner[held], weight[held])
                strip += 1
                held = held[weight[held] > 2.0 ** (strip - 1)]
            done = np.flatnonzero(open_sets & (need <= level))
            if len(done):
                open_sets[done] = (best.reshape(n, self.k)[done] == np.iinfo(np.uint64).max).any(1)
            level += 1
        out = best.reshape(n, self.k).astype(np.uint32)
        out[full] = 0
        return out

    def _throw(self, best: np.ndarray, level: int, strip: int, element: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        """The darts of one band of ranks and one strip of weights."""
        low = 0.0 if level == 0 else 2.0 ** (level - 1 - _LOW_BITS)
        height = 2.0 ** (level - _LOW_BITS) - low
        left, width = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1),) * 2
        cells = max(1, int(np.ceil(width * height)))
        step = height / cells
        cdf = _poisson_cdf(width * step)
        salt = (self.seed * 0x9E3779B9 + level * 0x85EBCA6B + (strip << 24) * 0xC2B2AE35) & (2**64 - 1)
        some = max(1, _PART // cells)
        for lo in range(0, len(element), some):
            of = np.repeat(np.arange(lo, min(lo + some, len(element))), cells)
            cell = np.tile(np.arange(cells, dtype=np.uint64), len(of) // cells)
            h = mix(element[of] + np.uint64(salt) + cell * np.uint64(0x27D4EB2F))
            u = _uniform(h)
            hit = np.flatnonzero(u > cdf[0])
            j = 0
            while len(hit):
                dart = mix(h[hit] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                inside = np.flatnonzero(left + width * _uniform(mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))) <= weight[of[hit]])
                dart, at = dart[inside], hit[inside]
                rank = low + (cell[at] + _uniform(mix(dart + np.uint64(0x632BE59BD9B4E019)))) * step
                packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
                slot = owner[of[at]] * self.k + ((dart >> np.uint64(32)) % np.uint64(self.k)).astype(np.int64)
                np.minimum.at(best, slot, packed)
                j += 1
                hit = hit[u[hit] > cdf[min(j, len(cdf) - 1)]]


def _sequence_key(words: Words) -> list[bytes]:
    """128 bits for each row's words and their order."""
    out = []
    for i in range(len(words)):
        h = words.row(i)
        place = mix(np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a = (mix(h + place)).sum(dtype=np.uint64)
        b = (mix(h ^ mix(place)) * np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
        out.append(np.array([a, b + np.uint64(len(h))], np.uint64).tobytes())
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, signature, version) of each row: signature is null for a text without words; its shingles weigh as often as they occur."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("signature", pa.binary()), ("version", pa.int64())])
    hasher = DartMinHash()

    def sign(batch: pa.RecordBatch) -> list:
        words = Words(batch.column("text"))
        signature: list[bytes | None] = [None] * len(words)
        sizes = np.diff(words.of_row)
        lo = 0
        while lo < len(words):  # some 100,000 words at a time
            hi = max(lo + 1, int(np.searchsorted(words.of_row, words.of_row[lo] + 100_000, "right")) - 1)
            sets = [np.unique(shingles(words.row(i), SHINGLE), return_counts=True) for i in range(lo, hi)]
            owner = np.repeat(np.arange(hi - lo), [len(x) for x, _ in sets])
            made = hasher.signatures(np.concatenate([x for x, _ in sets]), owner, np.concatenate([c for _, c in sets]).astype(np.float64), hi - lo)
            for i in np.flatnonzero(sizes[lo:hi]):
                signature[lo + i] = made[i].tobytes()
            lo = hi
        return [batch.column("doc_id"), _sequence_key(words), signature, batch.column("version")]

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))
    return rows.mapInArrow(batches(sign, schema), "doc_id long, text_key binary, signature binary, version long")


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b) pairs whose signatures agree in LEAST_AGREEMENT of the coordinates."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("keep", pa.bool_())])

    def compare(batch: pa.RecordBatch) -> list:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        return [batch.column("a"), batch.column("b"), (left == right).mean(1) >= LEAST_AGREEMENT]

    both = pairs.join(signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(batches(compare, schema), "a long, b long, keep boolean").where("keep").select("a", "b")


def elements(h: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: the n-th of equal ones is an element of its own, so that plain similarity of such sets is weighted similarity by counts."""
    s = np.sort(h)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return s
    first = np.flatnonzero(new)
    nth = (np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))).astype(np.uint64)
    return np.sort(np.where(nth > 0, mix(s + nth * np.uint64(0x9E3779B97F4A7C15)), s))


def _sets(ids: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, own) of these ids, each once: the elements of its text. first: (rep, version), the hash of the text that counts for an id."""
    needed = stored(first.select(F.col("rep").alias("doc_id"), "version").join(ids, "doc_id", "left_semi"), "needed")
    few = needed.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    texts = texts.join(F.broadcast(needed) if few else needed, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    schema = pa.schema([("rep", pa.int64()), ("own", pa.binary())])

    def cut(batch: pa.RecordBatch) -> list:
        words = Words(batch.column("text"))
        return [batch.column("doc_id"), [elements(shingles(words.row(i), SHINGLE)).tobytes() for i in range(len(words))]]

    own = stored(texts.mapInArrow(batches(cut, schema), "rep long, own binary"), "shingles")
    release(needed)
    return own


def _checked(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs with at least this similarity of their sets."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def compare(batch: pa.RecordBatch) -> list:
        made = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            made.append(both / (len(x) + len(y) - both))
        return [batch.column("a"), batch.column("b"), made]

    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("own").alias("sa")), "a").join(own.select(F.col("rep").alias("b"), F.col("own").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(batches(compare, out), "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def _measured(own: DataFrame) -> DataFrame:
    """(rep, size, common) of each set: how many elements it has, and how many of them another set holds too."""
    schema = pa.schema([("rep", pa.int64()), ("element", pa.int64()), ("size", pa.int32())])

    def flat(batch: pa.RecordBatch) -> list:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("own")]
        sizes = [len(x) for x in sets]
        return [np.repeat(np.asarray(batch.column("rep").to_numpy(zero_copy_only=False), np.int64), sizes), np.concatenate(sets), np.repeat(sizes, sizes)]

    held = own.mapInArrow(batches(flat, schema), "rep long, element long, size int")
    alone = held.groupBy("element").agg(F.min("rep").alias("rep"), F.min("size").alias("size"), F.count("*").alias("n")).where("n = 1")
    counted = alone.groupBy("rep").agg(F.count("*").alias("alone"))
    return own.select("rep", (F.octet_length("own") / 8).cast("int").alias("size")).join(counted, "rep", "left").select("rep", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _met(members: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of rows (bucket, rep, part, size) of one bucket and different parts with at least this similarity.

    A bucket's members are dealt to blocks of a bounded number of texts and elements, and each pair of
    blocks is a row, in which all pairs are counted by a product of matrices over the elements that two texts
    hold; only links come out. So no row and no join grows with a bucket.
    """
    crowd = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_ELEMENTS)).cast("int")
    dealt = members.join(crowd.select("bucket", blocks.alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bucket", "rep", "part", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(own, "rep")
    item = F.struct("rep", "part", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "own")
    tiles = dealt.groupBy("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(item).alias("held"))
    made = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batch: pa.RecordBatch) -> list:
        out = [np.zeros((2, 0), np.int64)]
        for tile in batch.column("held"):
            tile = tile.values
            rep, part, x, y = (np.asarray(tile.field(k).to_numpy(zero_copy_only=False)) for k in ("rep", "part", "left", "right"))
            sets = [np.frombuffer(o.as_buffer(), np.uint64) for o in tile.field("own")]
            size = np.array([len(o) for o in sets])
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = times > 1
            place = np.cumsum(shared) - 1
            row, column = np.repeat(np.arange(len(sets)), size)[shared[column]], place[column[shared[column]]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            x, y = np.flatnonzero(x), np.flatnonzero(y)
            both = np.zeros((len(x), len(y)), np.float32)
            for lo in range(0, int(shared.sum()), 4096):  # so many columns at a time
                a, b = np.searchsorted(column, (lo, lo + 4096))
                dense = np.zeros((len(sets), 4096), np.float32)
                dense[row[a:b], column[a:b] - lo] = 1
                both += dense[x] @ dense[y].T
            i, j = np.nonzero(both >= similarity * (size[x][:, None] + size[y] - both))
            a, b = rep[x[i]], rep[y[j]]
            keep = part[x[i]] != part[y[j]]
            out.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]))
        return list(np.unique(np.concatenate(out, 1), axis=1))

    return tiles.select("held").mapInArrow(batches(compare, made), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy_of, class_id) of each row: the least doc_id of its exact and of its near copies.

    Exact copies have the same words in the same order (case and punctuation aside; texts without words
    are copies of each other). Near copies have multisets of five-word shingles with a weighted Jaccard
    similarity of `similarity` or more, a shingle weighing as often as it occurs, and classes are the
    connected components of such links. doc_id is taken as a key: rows that repeat one are the same
    document (of unlike texts, that of least hash is compared), and null ids have null classes.

    One text of each group of copies goes on. In each band's bucket every text is first checked against
    the one that shares most buckets with others, as a rule the original of its copies, which joins most
    of a large group by as many pairs as it has members. Then texts of a bucket that are in different
    components still are checked against each other, block by block, so no link between different texts is
    lost. Such texts must hold `similarity` of their elements in common with other ones of them. Pairs with
    a hub pass through agreement of signatures; all links are checked exactly.
    """
    signatures = stored(signed(docs), "signatures")
    reps = stored(signatures.groupBy("text_key").agg(F.min("doc_id").alias("rep")), "text-keys")
    copies = stored(signatures.select("doc_id", "text_key").join(reps, "text_key").select("doc_id", "rep"), "copies")
    alone = signatures.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "text_key"], "left_semi").where("signature is not null")
    first = stored(alone.groupBy(F.col("doc_id").alias("rep")).agg(F.min("version").alias("version"), F.min_by("signature", "version").alias("signature")), "reps")
    release(signatures, reps)
    width = 4 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), 1 + i * width, F.lit(width))))
    buckets = stored(first.select("rep", F.explode(bands).alias("bucket")), "buckets")
    crowds = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    crowded = stored(buckets.join(crowds, "bucket"), "crowded")
    release(buckets, crowds)
    degrees = stored(crowded.groupBy("rep").agg(F.sum("n").alias("degree")), "degrees")
    hubs = stored(crowded.join(degrees, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("hub")), "hubs")
    shared = stored(crowded.join(hubs, "bucket").select("bucket", "hub", "rep"), "shared")
    release(crowded, degrees, hubs)
    star = stored(_agreeing(shared.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct(), first), "pairs")
    own = _sets(star.select(F.col("a").alias("doc_id")).union(star.select("b")), first, docs)
    links = stored(_checked(star, own, similarity), "links")
    release(star, own)
    joined = components(links)
    named = shared.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("class_id", "rep").alias("part"))
    mixed = stored(named.join(named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q"), "bucket", "left_semi"), "mixed")
    own = _sets(mixed.select(F.col("rep").alias("doc_id")), first, docs)
    sized = stored(mixed.join(_measured(own), "rep").where(f"common >= {similarity!r}D * size - 1e-6D").select("bucket", "rep", "part", "size"), "sized")
    more = stored(_met(sized, own, similarity), "links")
    release(shared, mixed, own, sized)
    if not more.isEmpty():
        joined = components(links.select("a", "b").union(more))
    release(more)
    return copies.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs' own columns: of each class, one row with its least doc_id (of several rows, one of the text of least hash); rows with a null doc_id stay."""
    kept = near_duplicates(docs, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith("map")])
    one = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), row.alias("_row"), F.struct(F.xxhash64("text"), order).alias("_order"))
    one = one.join(kept, F.col("_id") == F.col("_kept"), "left_semi").groupBy("_id").agg(F.min_by("_row", "_order").alias("_row"))
    return one.select("_row.*").unionByName(docs.where("doc_id is null"))
