"""Topic inference, training passes and the grid of models, with restarts."""

import json
import math
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid, topics, variational
from tessera.plans import queries
from tessera.sources import readers, sinks, zonefiles

SF = "/root/testdata/sf0.001"


def test_special_functions(spark):
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 17.0, 4000.0])
    assert variational.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    slope = [(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x]
    assert variational.digamma(x) == pytest.approx(slope, rel=1e-5, abs=1e-5)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(variational.digamma_column(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx(variational.digamma(x).tolist(), rel=1e-12)


def test_fold_in_against_plain_python(spark):
    table = {"a": [0.7, 0.1], "b": [0.2, 0.8], "c": [0.1, 0.1]}
    bags = [(1, "a", 3), (1, "b", 1), (1, "zz", 9), (2, "b", 2), (None, "c", 1), (3, "zz", 1)]
    alpha = [0.4, 0.6]
    frames = [spark.createDataFrame(bags, "doc_id long, term string, n long"), spark.createDataFrame(list(table.items()), "term string, weights array<double>")]
    docs = spark.createDataFrame([(1,), (2,), (None,), (3,), (4,), (4,)], "doc_id long")

    def mixture(doc):
        gamma = np.ones(2)
        held = [(n, np.array(table[w])) for d, w, n in bags if d == doc and w in table]
        for _ in range(variational.STEPS):
            theta = np.exp(variational.digamma(gamma))
            gamma = np.array(alpha) + sum((n * theta * b / (theta @ b) for n, b in held), np.zeros(2))
        return gamma / gamma.sum()

    got = {r["doc_id"]: r for r in variational.folded_in(*frames, alpha, docs=docs).collect()}
    assert set(got) == {1, 2, None, 3, 4}
    for doc, r in got.items():
        assert r["probabilities"] == pytest.approx(mixture(doc).tolist()) and r["dominant_topic"] == int(np.argmax(mixture(doc)))
    assert got[4]["probabilities"] == pytest.approx(alpha)
    assert {r["doc_id"] for r in variational.folded_in(*frames, alpha).collect()} == {1, 2, None}


def trained(spark, path, passes, k=4, **options):
    rows, words = queries._corpus(spark, SF)
    vocabulary = spark.createDataFrame(list(enumerate(words.vocabulary)), "term_id int, term string")
    bags = topics.bag_of_words(rows.select("doc_id", F.explode("tokens").alias("term")), "term").join(vocabulary, "term")
    variational.train(variational.documents(bags, k), variational.first_topics(vocabulary, k, 3), str(path), passes, [1 / k] * k, 0.05, **options)
    return variational.bounds(spark, str(path)).orderBy("pass").collect()


def test_the_bound_never_falls_over_50_passes(spark, tmp_path):
    rows = trained(spark, tmp_path / "t", 50, learn_prior=True)
    bound = [r["bound"] for r in rows]
    corpus, words = queries._corpus(spark, SF)
    known = corpus.where(F.arrays_overlap("tokens", F.lit(words.vocabulary))).count()  # the others add nothing to the bound
    assert len(rows) == 50 and {r["n_docs"] for r in rows} == {known} and known > 180
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(bound, bound[1:])) and bound[-1] > bound[0]
    assert rows[-1]["alpha"] != rows[0]["alpha"] and min(rows[-1]["alpha"]) > 0
    made = variational.trained_topics(spark, str(tmp_path / "t"), 50).collect()
    assert np.array([r["weights"] for r in made]).sum(0) == pytest.approx([1] * 4)


def test_a_broken_off_training_goes_on(spark, tmp_path):
    whole = trained(spark, tmp_path / "whole", 4)
    trained(spark, tmp_path / "part", 3)
    for name in ("passes/pass=3", "topics/3"):  # broken off within the third pass
        shutil.rmtree(tmp_path / "part" / name)
    (tmp_path / "part/docs/3/_SUCCESS").unlink()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "part/docs/2").rglob("*.parquet")}
    again = trained(spark, tmp_path / "part", 4)
    assert [(r["pass"], r["bound"], r["alpha"]) for r in again] == [(r["pass"], r["bound"], r["alpha"]) for r in whole]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "part/docs/2").rglob("*.parquet")}
    table = lambda at: {r["term_id"]: r["weights"] for r in spark.read.parquet(str(tmp_path / at / "topics/4")).collect()}
    assert table("part") == table("whole")


def test_training_without_documents(spark, tmp_path):
    words = spark.createDataFrame([(0, "a"), (1, "b")], "term_id int, term string")
    bags = spark.createDataFrame([], "doc_id long, term_id int, n long")
    variational.train(variational.documents(bags, 2), variational.first_topics(words, 2), str(tmp_path / "none"), 2, [0.5, 0.5], 0.1, True)
    assert [r["n_docs"] for r in variational.bounds(spark, str(tmp_path / "none")).collect()] == [0, 0]


def test_a_broken_off_grid_goes_on(spark, tmp_path):
    rows, words = queries._corpus(spark, SF)
    toks = rows.select("doc_id", F.posexplode("tokens").alias("place", "token"))
    chosen = {"counts": (3, 2), "alphas": ("auto", 0.5), "runs": 1, "max_iter": 3}
    seen = []

    def save(key, model):
        seen.append(key)
        assert model.vocabSize() == len(words.vocabulary)
        if len(seen) == 3:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        grid.run(rows, words, toks, str(tmp_path / "a"), at_once=1, save=save, **chosen)
    held = grid.coherence(spark, str(tmp_path / "a")).collect()
    assert len(held) == 2 and {(r["num_topics"], r["alpha"], r["iter"]) for r in held} == set(seen[:2])
    done = seen[:2]
    again = grid.run(rows, words, toks, str(tmp_path / "a"), at_once=4, save=save, **chosen)
    assert not set(done) & set(seen[3:]) and len(seen) == 5
    fresh = grid.run(rows, words, toks, str(tmp_path / "b"), at_once=4, **chosen)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fresh.collect())) and again.count() == 4
    for key in done:
        top = [sorted((r["topic_id"], r["rank"], r["term"]) for r in grid.model_table(spark, str(tmp_path / x), "topics", key).collect()) for x in "ab"]
        assert top[0] == top[1] != []
        assert grid.model_table(spark, str(tmp_path / "b"), "mixtures", key).count() == rows.count()


def test_zone_files(spark, tmp_path):
    rows = queries._zones(spark, SF)
    files = readers.with_path_parts(rows.select("doc_id").distinct().withColumn("path", F.concat(F.lit("in/pdf/Société/"), F.col("doc_id").cast("string"), F.lit(".pdf"))))
    sinks.zones(rows.withColumn("section", F.lit("Énergie")), files, str(tmp_path / "z"))
    found = sorted((tmp_path / "z").rglob("*"))
    names = [p for p in found if p.is_file()]
    assert {str(p.relative_to(tmp_path / "z")) for p in names} == {f"in/chunks_lexical/Société/{r['doc_id']}.json" for r in files.collect()}
    text = names[0].read_text()
    held = json.loads(text)
    assert text == json.dumps(held, ensure_ascii=False, indent=4) and "Énergie" in text
    assert list(held) == ["file", "path", "zones", "relevant_text"] and held["relevant_text"] == "\n\n\n\n".join(z["text"] for z in held["zones"])
    sinks.zones(rows.limit(0), files, str(tmp_path / "z"))  # overwritten by nothing
    assert not [p for p in (tmp_path / "z").rglob("*") if p.is_file()]


def test_a_failed_zone_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "z/kept.json").write_text("{}")
    zonefiles.register(spark)
    table = spark.range(40).select(F.when(F.col("id") == 33, "../out.json").otherwise(F.concat(F.lit("a/"), F.col("id").cast("string"))).alias("zone_path"), F.lit("f").alias("file"), F.lit("p").alias("path"), F.array().cast("array<string>").alias("zones"), F.lit("t").alias("relevant_text"))
    with pytest.raises(Exception, match="leaves the root"):
        table.repartition(4).write.format(zonefiles.FORMAT).mode("append").save(str(tmp_path / "z"))
    assert [str(p.relative_to(tmp_path)) for p in sorted(tmp_path.rglob("*"))] == ["z", "z/kept.json"]
    table.where("id <> 33").write.format(zonefiles.FORMAT).mode("append").save(str(tmp_path / "z"))
    assert len([p for p in Path(tmp_path / "z").rglob("*") if p.is_file()]) == 40


def test_dictionary_has_all_words(spark):
    """More words than a model's dictionary holds; with repeated ids, an id counts once."""
    rows = [(i % 6, f"aa{i % 2} bb bb cc{i}") for i in range(12)] + [(None, "bb"), (9, None)]
    clean = spark.createDataFrame(rows, "doc_id int, clean_text string")
    held = {r["word"]: r["df"] for r in topics.words_of(topics.topic_tokens(clean, ["cc1"]), min_df=1, max_df=0.85).collect()}
    assert held == {"bb": 6, "aa0": 3, "aa1": 3} | {f"cc{i}": 1 for i in range(12) if i != 1}
    made, model = topics.prepared(clean.where("clean_text is not null"), min_df=1, max_df=1.0, most=3)
    assert model.vocabulary == ["bb", "aa0", "aa1"]
    assert sorted(r["features"].toArray().tolist() for r in made.where("doc_id is null or doc_id = 0").collect()) == [[1, 0, 0], [2, 1, 0], [2, 1, 0]]


def test_many_documents_at_once(spark, monkeypatch):
    """Parts of a batch, documents without words and single ones have the mixtures of each document by itself; only topic words are grouped."""
    monkeypatch.setattr(variational, "_WORDS", 5)
    rng, sizes = np.random.default_rng(3), [0, 3, 0, 9, 1, 4, 0]
    of, alpha = np.append(0, np.cumsum(sizes)), np.array([0.5, 0.3])
    n, b = rng.integers(1, 5, of[-1]).astype(float), rng.random((of[-1], 2))
    parts = list(variational._parts(of))
    assert [lo for lo, _ in parts] == [0, *[hi for _, hi in parts[:-1]]] and parts[-1][1] == len(sizes) and len(parts) > 2
    got, _, _ = variational._mixtures(of, n, b, np.ones((len(sizes), 2)), alpha, 20)
    for d in range(len(sizes)):
        g, w = np.ones(2), slice(of[d], of[d + 1])
        for _ in range(20):
            theta = np.exp(variational.digamma(g))
            g = alpha + theta * ((n[w] / (b[w] @ theta)) @ b[w])
        assert got[d] == pytest.approx(g)
    bags = queries._topic_bags(spark, SF)
    words = {w for ws in queries.TOPIC_WORDS.values() for w in ws}
    every = topics.bag_of_words(queries._tokens(spark, SF)).withColumnRenamed("token", "term").where(F.col("term").isin(*words))
    assert sorted(map(tuple, bags.collect())) == sorted(map(tuple, every.collect()))


def test_lemma_pairs_are_made_once(spark):
    """The texts aren't read again for each use of the pairs."""
    plan = queries.lemma_suffix_rules(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_zone_file_texts_read_each_file_once(spark, tmp_path):
    for i, x in enumerate(['{"relevant_text": "a"}', '{"text": "b"}', '{"relev', '{"relevant_text": ""}']):
        (tmp_path / f"{i}.json").write_text(x)
    rows = readers.zone_file_texts(spark, str(tmp_path))
    assert sorted((r["json_path"][-6], r["relevant_text"], r["reason"]) for r in rows.collect()) == [("0", "a", None), ("1", "", "no relevant_text"), ("2", "", "not JSON"), ("3", "", None)]
    plan = queries.zone_file_errors(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "Join" not in plan


def test_passes_over_all_documents(spark):
    """A fit is what plain passes make of all rows, whatever the blocks; documents without known words, null and repeated ids have rows of mixtures."""
    from tessera.operators import passes

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"] if i % 2 else ["xx", "yy", "zz", "cc"], 30)) for i in range(30)] + ["other"]
    rows, words = topics.prepared(spark.createDataFrame([(None if i == 7 else i // 2, x) for i, x in enumerate(texts)], "doc_id int, clean_text string").repartition(3), [], min_df=2, max_df=1.0)
    with passes.Corpus(rows, words) as corpus:
        model = corpus.fit(2, seed=3, passes=12)
        mixed = corpus.mixtures(model)
        fixed = corpus.fit(2, alpha=0.4, seed=3, passes=12)
    bags = [[(words.vocabulary.index(w), float(n)) for w, n in zip(*np.unique(x.split(), return_counts=True)) if w in words.vocabulary] for x in texts]
    weights, gammas, alpha = np.random.default_rng(3).gamma(100.0, 0.01, (2, len(words.vocabulary))), [np.ones(2) for _ in bags], np.full(2, 0.4)
    for _ in range(12):
        beta = np.exp(variational.digamma(weights) - variational.digamma(weights.sum(1, keepdims=True)))
        weights = np.full(weights.shape, 0.5)
        for d, bag in enumerate(bags):
            at, n = np.array([w for w, _ in bag], int), np.array([x for _, x in bag])
            for _ in range(passes.ROUNDS if bag else 0):
                theta = np.exp(variational.digamma(gammas[d]))
                new = alpha + theta * (beta[:, at] * (n / (theta @ beta[:, at]))).sum(1)
                moved, gammas[d] = np.abs(new - gammas[d]).mean(), new
                if moved < passes.SETTLED:
                    break
            theta = np.exp(variational.digamma(gammas[d]))
            for w, x in bag:
                weights[:, w] += x * theta * beta[:, w] / (theta @ beta[:, w])
    assert fixed.weights == pytest.approx(weights, rel=1e-6) and fixed.alpha.tolist() == [0.4, 0.4]
    assert model.alpha.tolist() != [0.5, 0.5] and min(model.alpha) > 0
    got = mixed.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(None if i == 7 else i // 2) for i in range(31))
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in got)
    assert {r["doc_id"]: r["probabilities"] for r in got}[15] == pytest.approx((model.alpha / model.alpha.sum()).tolist())
    tops = [{r["term"] for r in passes.top_terms(model, spark, 3).where(f"topic_id = {t}").collect()} for t in range(2)]
    assert any({"aa", "bb"} <= t and not t & {"xx", "yy", "zz"} for t in tops) and any(len(t & {"xx", "yy", "zz"}) >= 2 for t in tops)


def test_blocks_do_not_show(spark, monkeypatch):
    """Small groups and blocks give the mixtures of one whole group; a pass shuffles no blocks."""
    from tessera.operators import passes

    rows, words = queries._corpus(spark, SF)
    found = []
    for pairs, added, partition in ((1 << 14, 1 << 20, 1 << 22), (300, 900, 2000)):
        for name, x in (("_PAIRS", pairs), ("_ADDED", added), ("_PARTITION", partition)):
            monkeypatch.setattr(passes, name, x)
        with passes.Corpus(rows, words) as corpus:
            model = corpus.fit(3, seed=1, passes=3)
            found.append({r["doc_id"]: r["probabilities"] for r in corpus.mixtures(model).collect()})
            plan = passes._inferred(corpus.blocks, model.mixtures, model.weights, model.alpha)._jdf.queryExecution().executedPlan().toString()
            assert plan.split("InMemoryRelation")[0].count("Exchange") == 0 and "ShuffledHashJoin" in plan and plan.count("ENSURE_REQUIREMENTS") == 1
    assert found[0].keys() == found[1].keys() and len(found[0]) == rows.select("doc_id").distinct().count()
    assert all(found[0][d] == pytest.approx(found[1][d], abs=1e-4) for d in found[0])


def test_word_counts_of_batches(spark):
    """Occurrences and rows of a word, of null tokens and rows too."""
    toks = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (2, None), (3, []), (4, [None, "b"])], "doc_id int, tokens array<string>").repartition(3)
    assert sorted(map(tuple, topics._frequencies(toks).collect())) == [("a", 3, 2), ("b", 2, 2)]
    plan = topics._frequencies(toks)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # occurrences aren't rows
