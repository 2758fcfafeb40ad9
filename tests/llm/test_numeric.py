"""Top-k, mixing, token files, decontamination and near duplicates against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, minhash, mixing, tokenfile, topk
from tessera.llm.common import Words, components, shingles
from tessera.llm.queries import word_count

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w.decode() for w in WORD.findall(bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()))]


def test_words_match_regex_over_chunks(monkeypatch):
    from tessera.llm import common

    texts = ["Ab c-d é Ü9", None, "", "x" * 50 + " " + "y" * 3, "...", "end", "more words here and there " * 9]
    for chunk in (4, 7, 1 << 20):
        monkeypatch.setattr(common, "_CHUNK", chunk)
        w = Words(pa.array(texts))
        assert [[w.word(k) for k in range(w.of_row[i], w.of_row[i + 1])] for i in range(len(texts))] == [words(t) for t in texts]
    h = Words(pa.array(["a b a", "B A"]))
    assert h.row(0)[0] == h.row(0)[2] == h.row(1)[1] and h.row(0)[1] == h.row(1)[0]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5), (20, 3)], "a long, b long")
    assert {r["id"]: r["class_id"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}
    assert components(links.where("false")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["class_id"] for r in components(chain).collect()} == {0}


def test_top_k_ties_nulls_and_own(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-0.001, 0.0]), (50, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [])]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v.where("vec_id % 50 = 0"), v, 3, doc_block=2, query_block=1).collect()}
    own = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    for q in (0, 50):
        want = sorted(((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q))[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in want]
    assert topk.top_k(v.where("false"), v).count() == 0
    assert topk.top_k(v, v.where("false")).count() == 0


def test_top_k_of_large_components_and_repeated_rows(spark):
    big = 2.0**30
    rows = [(0, [big, big]), (1, [big, -big]), (2, [1.0]), (2, [1.0]), (3, [big, big]), (3, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v"), F.lit(1).alias("rank"), F.lit(2).alias("qb"))
    query = v.where("vec_id = 1")
    got = [tuple(r) for r in topk.top_k(query, v, 6).orderBy("rank").collect()]
    assert got == [(1, 1, 3, 512 * 2**38), (1, 2, 2, 2**46), (1, 3, 2, 2**46), (1, 4, 0, 0), (1, 5, 3, 0)]  # sums of products beyond 64 bits cancel
    for e in ([2.0**60], [big, big]):
        bad = spark.createDataFrame([(0, e), (1, e)], "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
        with pytest.raises(Exception, match="range of long|too large|OverflowError"):
            topk.top_k(bad, bad).collect()


def test_mix_targets_and_limits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("target", F.lit("x")).withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    rows = mixing.assigned(docs.drop("target"), word_count()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) and all(r["taken"] <= 2 * r["size"] for r in v)
        assert all(0 <= p <= 1 for r in v for p in r["positions"])
    again = mixing.mixed(docs, word_count())
    assert again.columns == docs.columns and again.count() == sum(len(r["positions"]) for r in rows)
    assert mixing.assigned(docs.drop("target").where("false"), word_count()).count() == 0


def test_mix_of_ties_and_null_ids(spark, monkeypatch):
    rows = [(i % 5 if i % 3 else None, f"w{i % 4} x" * (i % 7), None if i % 4 == 0 else "s") for i in range(200)] + [(1, None, "s"), (1, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(0), "taken": F.lit("x"), "positions": F.lit(2)}).drop("size", "taken", "positions")
    take = lambda d: sorted(map(str, mixing.assigned(d, word_count()).select("doc_id", "text", "source", "taken", "positions").collect()))
    one = take(docs)
    assert len(one) == len(rows) and one == take(docs.repartition(7))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0)
    assert take(docs) == one


def test_water_level():
    """Against repeated resharing."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    sizes = {"a": 10, "b": 500, "c": 3, "d": 0, None: 60}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_equals_library(bpe):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe)
    plain.encode_special_tokens = False
    odd = [None, "", " ", "  a", "a  b", "a \n b", "a\t b ", " x", "\n\n x", "é  y", "　 z", "a  b", "it's we'll <|endoftext|> done", "12 345  6", "日本 語 text", "a​ b", " ", "a \x1c b", "x\x85 y"]
    texts = odd + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("ab's \n\t.,1-\u00a0\u3000\u2014\u00e9\u200b\r I'LLre"), 30)) for _ in range(3000)]
    ids, at = tokenfile.Encoder(bpe).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], repr(t)
    small = tokenfile.Encoder(bpe)
    small.BITS = 12  # emptied again and again
    small._clear()
    for lo in range(0, len(texts), 20):
        part, offsets = small.encode(pa.array(texts[lo : lo + 20]))
        assert part.tolist() == ids[at[lo] : at[min(lo + 20, len(texts))]].tolist() and len(offsets) == len(texts[lo : lo + 20]) + 1
    assert [x.tolist() for x in small.encode(pa.array([], pa.string()))] == [[], [0]]


def test_token_files(spark, bpe, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe)
    rows = [(5, "b b"), (3, None), (9, "c"), (3, "aa"), (7, "d " * 5000), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, bpe)
    got = sorted(tokenfile.digest(tokenfile.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    start = 0
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t or "", 42)).astype(np.int64))
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))), strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    part = next(p for p in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    column = next(c for c in (pq.ParquetFile(part).metadata.row_group(0).column(i) for i in range(3)) if "ids" in c.path_in_schema)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index
    tokenfile.write_tokens(docs.where("false"), str(tmp_path / "none"), bpe)
    assert tokenfile.digest(tokenfile.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def test_token_files_that_are_split(spark, bpe, tmp_path):
    """Files after each second row, as a session may ask for, several row groups and a very long row."""
    rows = [(i, f"row {i} " * (i % 5)) for i in range(40)] + [(40, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, tokenfile.token_output(docs, bpe).collect()))
    plain = tokenfile.WRITER
    try:
        tokenfile.WRITER = plain | {"maxRecordsPerFile": "2", "parquet.block.size": "1024"}
        tokenfile.write_tokens(docs, str(tmp_path / "split"), bpe)
    finally:
        tokenfile.WRITER = plain
    assert len(list((tmp_path / "split").glob("*.parquet"))) > 15
    assert sorted(map(tuple, tokenfile.digest(tokenfile.read_tokens(spark, str(tmp_path / "split"))).collect())) == want
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        assert sorted(map(tuple, tokenfile.token_output(docs, bpe).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_encoder_of_another_pattern(bpe, tmp_path):
    import json

    from tokenizers import Tokenizer

    held = json.load(open(bpe))
    held["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(held))
    plain, texts = Tokenizer.from_file(str(tmp_path / "other.json")), ["one two", None, "", "a\nb  c"]
    ids, at = tokenfile.Encoder(str(tmp_path / "other.json")).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2]


def brute_overlap(text, items, n=13):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        k = min(n, len(v))
        grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
        for j in range(len(w) - k + 1):
            if k and tuple(w[j : j + k]) in grams:
                hit |= set(range(j, j + k))
                ids.add(str(i))
    return len(w), len(hit), len(ids), decontam.sha256_of(ids), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([("i", "one two three"), (None, "four five"), ("j", "six " * 20)], "item_id string, text string")
    rows = [(None, "one two three"), (None, "x"), (7, "Four, five"), (7, "Four, five"), (8, "six " * 200_000 + "seven"), (9, "six " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["contaminated"]) for r in decontam.judged(decontam.overlaps(docs, items)).collect())
    assert got == [(-1, 1, 0, False), (-1, 3, 3, True), (7, 2, 2, True), (7, 2, 2, True), (8, 200_001, 200_000, True), (9, 12, 0, False)]


@pytest.mark.parametrize("block", [50_000, 5])
def test_decontamination(spark, block):
    items = [(1, " ".join("abcdefghijklmnopq")), (2, "Short item"), (10, "one"), (3, ""), (4, None), (5, " ".join("cdefghijklmnoXY")), (6, "a a a a a a a a a a a a a a a a"), (2, "Short item")]
    texts = ["x one y short ITEM z", " ".join("zzabcdefghijklmnopqzz"), None, "", "... !!", "one", "a " * 40, "short", "c d e f g h i j k l m n o", "q " * 300 + "one", "é short item ü", "short, item. one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("items", F.lit("x"))
    out = decontam.judged(decontam.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()}
    assert got == {i: brute_overlap(t, items) for i, t in enumerate(texts)}
    none = decontam.judged(decontam.overlaps(docs, spark.createDataFrame([], "item_id long, text string")))
    assert none.where("n_hit > 0 or contaminated").count() == 0
    long = decontam.decontaminated(spark.createDataFrame([(1, "q " * 400 + "Short, item. end", 5)], "doc_id long, text string, spans int"), spark.createDataFrame(items, "item_id long, text string"), longest=1)
    assert [tuple(r) for r in long.collect()] == [(1, "q " * 400 + ". end", 5)]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    hasher = minhash.DartMinHash(k=2000)
    element = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 60)
    a[:10] = 0.0
    s = hasher.signatures(np.concatenate([element[a > 0], element]), np.repeat([0, 1], [50, 60]), np.concatenate([a[a > 0], b]), 3)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04 and not s[2].any()
    big = mixed = rng.integers(0, 2**63, 30_000).astype(np.uint64)
    mixed = np.concatenate([big[:24_000], big[:100]])
    s = hasher.signatures(np.concatenate([big, mixed]), np.repeat([0, 1], [len(big), len(mixed)]), np.ones(len(big) + len(mixed)), 2)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.04
    a, b = rng.geometric(0.01, 40).astype(float), rng.geometric(0.01, 40).astype(float)  # heavy elements, some of a weight of hundreds
    b[:30] = a[:30]
    s = hasher.signatures(np.concatenate([element[:40]] * 2), np.repeat([0, 1], 40), np.concatenate([a, b]), 2)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def brute_classes(rows, limit=0.8):
    """Classes by weighted Jaccard similarity of the counts of five-word shingles."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = (Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter(), tuple(w))
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    held = defaultdict(list)
    for i, (s, w) in sets.items():
        for g in s or {()}:
            held[g].append(i)
    for pair in {(a, b) for v in held.values() for a in v for b in v if a < b}:
        (s, w), (t, x) = (sets[i] for i in pair)
        if w == x or s and t and (s & t).total() >= limit * (s | t).total():
            a, b = sorted(map(find, pair))
            up[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [f"w{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(0, 60, 2)]  # near copies of each other in part
    rows += [(2000, None), (2001, ""), (2002, "..."), (2003, "one two"), (2004, "One, two"), (2005, "two one")]
    rows += [(2100, "p q r s t " * 3), (2101, "p q r s t " * 300), (2102, "p q r s t " * 290), (2103, " ".join(base) + " again" * 30), (2104, " ".join(base) + " again" * 200), (2105, " ".join(f"v{i}" for i in range(30_000))), (2106, " ".join(f"v{i}" for i in range(1, 30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(1))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert got[2101] == got[2102] != got[2100] and got[2103] != got[2104] and got[2105] == got[2106]


def test_near_duplicates_of_odd_ids(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(3, " ".join(base)), (5, " ".join(base)), (5, " ".join([*base[:39], "x"])), (7, " ".join([*base, "y"])), (None, " ".join(base)), (None, "alone"), (9, None), (9, "alone too"), (9, "alone too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "signature": F.lit(2)})
    one, two = (sorted((r["doc_id"] or -1, r["copy_of"] or -1, r["class_id"] or -1) for r in minhash.near_duplicates(d).collect()) for d in (docs, docs.repartition(5)))
    assert one == two and len(one) == len(rows) and {c for i, _, c in one if i in (3, 5, 7)} == {3}
    kept = minhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, -1, 3, 9]


def test_links_that_no_hub_has(spark):
    """Copies of one text that are too far from it, in twos that are near each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(12):
        far = list(base)
        for at in rng.sample(range(150), 7):
            far[at] = f"x{i}n{at}"
        near = list(far)
        near[rng.randrange(150)] = f"y{i}"
        rows += [(2 * i + 1, " ".join(far)), (2 * i + 2, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_shingles():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(shingles(h, 5)) == 4 and len(shingles(h[:3], 5)) == 1 and not len(shingles(h[:0], 5))
    assert shingles(h, 5)[1] == shingles(h[1:], 5)[0]
