"""Each stage of the pipeline against plain Python on what the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_numeric import brute_classes, brute_overlap

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tessera.llm import tokenfile, toxicity
    from tessera.llm.common import load, stored

    docs, names = load(spark, SF, "documents"), load(spark, SF, "documents").columns
    steps = []
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF), name)
        assert kept.columns == names
        steps.append((docs.collect(), kept.collect()))
        docs = kept
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    (every, clean), (_, single), (_, free), (_, mix) = steps
    first = load(spark, SF, "documents")
    scores = toxicity.classified(first, toxicity.train(first, load(spark, SF, "labels"))).collect()
    assert ids(clean) == sorted(r["doc_id"] for r in scores if r["score"] < 0.5) and len(clean) > 0.8 * len(every)
    assert ids(single) == sorted(set(brute_classes([(r["doc_id"], r["text"]) for r in clean]).values()))
    items = [(r["item_id"], r["text"]) for r in load(spark, SF, "benchmark").collect()]
    assert ids(free) == sorted(r["doc_id"] for r in single if not brute_overlap(r["text"], items)[4])
    times = Counter(ids(mix))
    assert set(times) <= set(ids(free)) and set(times.values()) <= {1, 2}
    total = sum(len(r["text"].split()) for r in free)
    assert abs(sum(len(r["text"].split()) for r in mix) - 1.5 * total) < 0.2 * total
    got = sorted(pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: r["start"])
    start, plain = 0, tokenfile.Encoder(pipeline.tokenizer()).tokenizer
    place = {(r["f"], r["i"]): r for r in docs.selectExpr("*", "_metadata.file_name as f", "_metadata.row_index as i").collect()}
    assert len(place) == len(mix)
    for r, (_, d) in zip(got, sorted(place.items()), strict=True):
        code = np.array([*plain.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (d["doc_id"], start, len(code), zlib.crc32(code.tobytes()))
        start += len(code)
