"""Odd rows through each stage of the pipeline, and the classifiers' scores against naive ones."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, tokenfile, toxicity
from tessera.llm.common import stored

SF = "/root/testdata/sf0.001"
#: Columns of documents and some that have the names of the stages' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, held_out string, size string, class_id long, taken long, _row string, ids string, `a.b` string"
#: No label has such an id, so that nothing is learned from these rows.
BASE = 1 << 40


def odd_rows():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    extra = (7.5, 9, "h", "s", 5, 6, "r", "i", "dot")
    rows = [(BASE + i, " ".join(rng.choices(words, k=40)), "en", f"s{i % 3}", 1, *extra) for i in range(30)]
    rows += [(BASE + 100, None, None, None, None, *[None] * 9), (BASE + 101, "", "en", "s0", 0, *extra), (None, "null id one", "en", "s1", 3, *extra), (None, "null id two", "en", None, 3, *extra)]
    rows += [rows[0], rows[0], (BASE + 200, rows[1][1], "fr", "s2", 1, *extra), (BASE + 201, rows[1][1], "fr", "s2", 1, *extra)]  # repeated rows, copies
    rows += [(BASE + 300, " ".join(rng.choices(words, k=60_000)), "en", "s0", 9, *extra)]  # very long
    return rows


def test_odd_rows_pass_each_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, names = spark.createDataFrame(odd_rows(), SCHEMA), SCHEMA.replace("`", "").split(", ")
    names = [n.rsplit(" ", 1)[0] for n in names]
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == names, name
        kept[name] = [tuple(r) for r in docs.collect()]
    every = Counter(odd_rows())
    assert Counter(kept["toxicity"]) == every  # nothing toxic, and the columns keep their values
    single = Counter(kept["near_duplicates"])
    ids = Counter(r[0] if r[0] is None else r[0] - BASE for r in kept["near_duplicates"])
    assert ids[None] == 2 and ids[0] == 1 and ids[1] == 1 and not ids[200] + ids[201] and ids[300] == 1
    assert ids[100] + ids[101] == 1  # a null text and an empty one are near duplicates
    assert all(single[r] <= every[r] for r in single)
    assert Counter(kept["decontamination"]) == single
    mix = Counter(kept["mixing"])
    assert set(mix) <= set(single) and set(mix.values()) <= {1, 2} and not any(r[0] in (BASE + 100, BASE + 101) for r in mix)
    out = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encoder = tokenfile.Encoder(pipeline.tokenizer())
    want = Counter((r[0], len(encoder.encode(pa.array([r[1]]))[0])) for r in mix.elements())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_each_stage_of_an_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0, name
        if name != "token_output":
            assert out.columns == empty.columns


def test_pooled_responses_against_single_chunks(monkeypatch):
    monkeypatch.setattr(quality, "_PIECE", 512)
    net, r = quality.Network.new(), np.random.default_rng(2)
    for n in [0, 1, 7, 8, 9, 16, 17, 511, 512, 513, 520, 521, 1024, 1032, 1033, *r.integers(0, 3000, 40)]:
        raw = r.integers(0, 256, int(n)).astype(np.uint8)
        padded = np.append(raw, np.full(quality.CHUNK * 2, 256))
        starts = range(0, max(1, len(raw) - quality.STRIDE), quality.STRIDE)
        naive = [sum(net.vectors[padded[s + j]] @ net.filters[j * quality.WIDTH : (j + 1) * quality.WIDTH] for j in range(quality.CHUNK)) + net.shift for s in starts]
        assert net.pooled(raw) == pytest.approx(np.maximum(np.max(naive, 0), 0), abs=1e-4), n
        text = bytes(raw % 95 + 32).decode()
        p = 1 / (1 + math.exp(-float(net.pooled(np.frombuffer(text.encode(), np.uint8)) @ net.weights + net.bias[0])))
        assert float(net(pa.array([text]))[0]) == pytest.approx(p, abs=1e-5)


def test_noisy_or_against_plain_python():
    r = np.random.default_rng(4)
    model = toxicity.Model(np.maximum(r.normal(0, 1, 1 << toxicity.BITS), 0).astype(np.float32), -3.0)
    texts = ["One two. Three!", "", None, "no end", "... ! ?", "a\nb\nc", "Über uns? ja.", "x. " * 200]

    def one(text):
        rest = 1.0
        for sentence in re.split(r"[\n!.?]", text or ""):
            s = toxicity.Sentences(pa.array([sentence]))
            if len(s.words.starts):
                z = float(model.weights[s.bucket].sum()) + model.bias
                rest *= 1 - 1 / (1 + math.exp(-z))
        return 1 - rest

    assert model(pa.array(texts)).tolist() == pytest.approx([one(t) for t in texts], abs=1e-5)


def test_the_gradient_of_noisy_or_fits_the_labels():
    """Documents with one bad word in one of their sentences: its weight grows, that of others doesn't."""
    texts = ["fine words here. more of it"] * 30 + ["fine words here. you rotten thing. more of it"] * 30
    s = toxicity.Sentences(pa.array(texts))
    packed = sum(x.astype(np.int64) << k * toxicity.BITS for k, x in enumerate(s.bucket))
    model = toxicity.fit(packed, s.first, s.row, np.repeat([0, 1], 30))
    p = model(pa.array(["fine words", "rotten fine words", "you rotten thing"]))
    assert p[0] < 0.1 and p[0] < p[1] < p[2] and p[2] > 0.8
