"""Golden rows, properties and file round trips of the base engine."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocab
from tessera.operators import lexical, metadata, scoring, topics
from tessera.operators import zones as Z
from tessera.plans import pipeline, queries
from tessera.sources import readers, sinks
from tessera.streaming import landing

SF = "/root/testdata/sf0.001"
KW = T.keyword_pattern()


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "hits"), [("Carbon emissions and CO2e; scope 3.", ["Carbon", "emissions", "CO2e", "scope 3"]), ("renewable energy", ["renewable"]), ("social energy", []), ("paris\n\nagreement", ["paris\n\nagreement"])])
def test_keywords(spark, text, hits):
    assert value(spark, T.found(F.col("t"), KW), t=text) == hits


def test_vocabulary_sizes():
    assert (len(vocab.TERMS), len(vocab.EXTRA_PATTERNS), len(set(vocab.STOP_WORDS)), len(set(vocab.TOPIC_STOP_WORDS)), len(vocab.COUNTRY_ALIASES), len(vocab.COMPANY_ALIASES)) == (32, 25, 188, 85, 7, 38)


@pytest.mark.parametrize(("text", "table"), [("12 345 678", True), ("carbon 12345678", False), ("OUR\nSTRATEGY", True), ("A sentence.\nand more", False), ("", False), ("1²３", True)])
def test_tables(spark, text, table):
    assert value(spark, T.is_table(F.col("t"), KW), t=text) is table


@pytest.mark.parametrize(("text", "heading"), [("CLIMATE STRATEGY", True), ("A B C D", False), ("Climate", False), ("WWW.ACME.COM", False), ("", False), ("A", False), (" ".join(["AB"] * 11), False)])
def test_headings(spark, text, heading):
    assert value(spark, T.is_heading(F.col("t")), t=text) is heading


def test_scalar_functions(spark):
    assert value(spark, T.clean_block(F.col("t")), t="see https://x.y/z sustain-\nability é") == "see sustainability"
    assert value(spark, T.clean_block(F.col("t")), t="a-\nb-\nc") == "ab- c"
    for name, year in (("AR19.pdf", "2019"), ("rep2021.pdf", "2021"), ("x120345", "2034"), ("foo", "N/A"), ("year19 a", "2019")):
        assert value(spark, T.year_of_name(F.col("t")), t=name) == year
    for year, n in (("2018", 2018), ("2018.0", 2018), ("N/A", None), ("inf", None), (None, None)):
        assert value(spark, T.year_number(F.col("t")), t=year) == n
    for cell, kind in (("0", None), (None, None), (" CSR ", "CSR"), ("0.0", None)):
        assert value(spark, T.cell(F.col("t")), t=cell) == kind
    assert value(spark, T.running_key(F.col("t")), t=" Page 12 of ３4 ") == "Page # of #"
    assert value(spark, T.zone_path(F.col("t")), t="data/pdf/x/pdfs/a.pdf.pdf") == "data/chunks_lexical/x/chunks_lexicals/a.chunks_lexical.json"
    assert [T.normal_name(x) for x in ("VINCI S.A", "  Société  Générale ", None, "L'Oréal")] == ["VINCI S A", "SOCIETE GENERALE", None, "L OREAL"]
    lists = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]


def make_zones(spark, hot, n, least=0, context=1):
    rows = [(1, i, "carbon" if i in hot else "filler", i * 10, i * 10 + 6, -1, "") for i in range(n)]
    paras = spark.createDataFrame(rows, "doc_id long, para_idx int, text string, start_char long, end_char long, section_idx int, section string")
    return sorted((r["lo"], r["hi"]) for r in Z.zones(paras, KW, least=least, context=context).collect())


def test_windows(spark):
    assert make_zones(spark, {1, 2, 7}, 10) == [(0, 3), (6, 8)]
    assert make_zones(spark, {1, 4}, 10) == [(0, 5)]
    assert make_zones(spark, {1, 5}, 10) == [(0, 2), (4, 6)]
    assert make_zones(spark, {1}, 10, least=150) == [] and make_zones(spark, set(), 5) == []


def test_windows_like_plain_loop(spark):
    r = random.Random(5)
    for context in (0, 1, 3):
        n = 40
        hot = {i for i in range(n) if r.random() < 0.15}
        spans = []
        for i in sorted(hot):
            lo, hi = max(0, i - context), min(n - 1, i + context)
            if spans and lo <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        assert make_zones(spark, hot, n, context=context) == spans


def test_density_is_inclusive(spark):
    for n, hot in ((99, 1), (100, 0)):
        paras = spark.createDataFrame([(1, 0, "carbon " + "w " * n, 0, 9, -1, "")], "doc_id long, para_idx int, text string, start_char long, end_char long, section_idx int, section string")
        assert Z.zones(paras, KW, least=0).count() == hot


def test_offsets_and_sections(spark):
    units = spark.createDataFrame([(1, 0, "abc", False), (1, 1, "HI", True), (1, 2, "de", False)], "doc_id long, unit_idx int, text string, is_marker boolean")
    got = [tuple(r)[1:] for r in Z.paragraphs(units).orderBy("para_idx").collect()]
    assert got == [(0, "abc", 0, 3, -1, ""), (1, "de", 13, 15, 0, "HI")]


def blocks(spark, doc="data/pdf/SPAIN/ACME/rep2020.pdf", pages=10, headers=4):
    body = "Our carbon emissions fall and renewable power grows every year. " * 3
    rows = []
    for p in range(pages):
        if p < headers:
            rows.append((doc, p, 0, 0.0, 10.0, 100.0, 20.0, f"Page {p}", 0, 600.0, 800.0))
        rows.append((doc, p, 1, 0.0, 200.0, 100.0, 300.0, body + str(p), 0, 600.0, 800.0))
        rows.append((doc, p, 2, 0.0, 100.0, 100.0, 120.0, "CLIMATE STRATEGY" if p == 3 else f" Page {p} ", 0, 600.0, 800.0))
        rows.append((doc, p, 3, 0.0, 400.0, 100.0, 500.0, "12 345 678", 0, 600.0, 800.0))
        rows.append((doc, p, 4, 0.0, 500.0, 100.0, 600.0, "an image", 1, 600.0, 800.0))
    return spark.createDataFrame(rows, "doc_id string, page_no int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, btype int, page_w double, page_h double"), spark.createDataFrame([(doc, p) for p in range(pages)], "doc_id string, page_no int")


def test_running_headers_need_more_than_the_share(spark):
    assert Z.running_blocks(*blocks(spark, headers=3)).count() == 0
    assert [r["key"] for r in Z.running_blocks(*blocks(spark, headers=4)).collect()] == ["Page #"]
    assert Z.units(*blocks(spark, headers=4)).where("text like 'Page%'").count() == 0
    assert Z.units(*blocks(spark, headers=3)).where("text like 'Page%'").count() == 9


def test_metadata(spark):
    sheet = spark.createDataFrame([(" france ", "Vinci", "x", "CSR", "0"), ("FRANCE", "VINCI", "x", " AR ", None), (None, "Lost", "x", "a", "b")], "c string, d string, note string, `2018` string, `2019` string")
    dim = metadata.dimension(metadata.sheet_to_long(sheet, "c", "d", ["note", "2018", "2019"]))
    assert {(r["company_norm"], r["year"], r["doc_type"]) for r in dim.collect()} == {("VINCI", 2018, "AR"), ("VINCI", 2019, None)}
    corpus = spark.createDataFrame([("Francia", "VINCI S.A", "2018"), ("FRANCE", "Vinci", "2019"), ("FRANCE", "vinci", "N/A"), ("ESPAÑA", "x", "2018.0")], "country string, company string, year string")
    assert [r["doc_type"] for r in metadata.with_doc_type(corpus, dim).orderBy("company", F.desc("year")).collect()].count("AR") == 1
    keys = metadata.with_keys(corpus).collect()
    assert {r["country_key"] for r in keys} == {"FRANCE", "SPAIN"} and {r["company_norm"] for r in keys} == {"VINCI", "X"}


def test_scores(spark):
    docs = spark.createDataFrame([(1, "carbon"), (2, "carbon carbon carbon"), (3, "nothing"), (4, "carbon solar 2030% may grow may")], "doc_id long, text string")
    sus = {r["doc_id"]: r["sus"] for r in scoring.breadth(docs).collect()}
    assert sus[1] == sus[2] == pytest.approx(1 / 32) and sus[3] == 0 and 1 / 32 < sus[4] <= 1 / math.sqrt(32)
    assert {r["doc_id"]: r["quant"] for r in scoring.quant(docs).collect()}[4] == pytest.approx(2 / 6)
    assert {r["doc_id"]: r["hedge"] for r in scoring.hedge(docs, ["may"]).collect()}[4] == pytest.approx(2 / 6)
    pol = {r["doc_id"]: r["sen"] for r in scoring.polarity(docs, ["carbon"], ["grow"]).collect()}
    assert pol[1] == pytest.approx(1 / (1 + 1e-6)) and pol[3] == 0
    assert {r["doc_id"]: r["sen"] for r in scoring.polarity(docs, ["carbons"], ["growing"], stem=True).collect()} == pytest.approx(pol)
    z = [r["z_v"] for r in scoring.zscores(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), ["v"]).orderBy("v").collect()]
    assert z == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert {r["z_v"] for r in scoring.zscores(spark.createDataFrame([(0.1,)] * 3, "v double"), ["v"]).collect()} == {0.0}
    labelled = scoring.scored(docs, vocab.TERMS, ["carbon"], ["grow"], ["may"])
    assert {(r["idx"] > 0) == (r["label"] == vocab.FLAGGED) for r in labelled.collect()} == {True}
    odd = spark.createDataFrame([(0.00003, 0.0), (0.5, float("nan"))], "idx double, idx_ext double")
    assert tuple(scoring.flag_summary(odd).first()) == (2, 1, 0)


def test_tokens_and_stems(spark):
    assert [lexical.porter_stem(w) for w in "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti sensibiliti triplicate formative electriciti hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate homologous effective bowdlerize probate rate cease controll roll".split()] == "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall hiss fizz fail file happi sky relat condit ration valenc digit oper feudal decis hope formal sensibl triplic form electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ homolog effect bowdler probat rate ceas control roll".split()
    docs = spark.createDataFrame([(1, "The companies See https://x.y/a grew b2b at Paris ab")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("companies", "company"), ("grew", "grow")], "token string, lemma string")
    assert lexical.clean_text(lexical.kept_tokens(lexical.tokens(docs), ["the"], lemmas)).first()["clean_text"] == "company see grow"


def test_topic_measures(spark):
    pairs = [([["a"], ["b"]], [["b"], ["a"]]), ([["a"], ["b"]], [["a"]]), ([], []), ([["a", "b"], ["a"]], [["a", "c"], ["a", "d"], ["a"]])]
    lists = spark.createDataFrame(pairs, "a array<array<string>>, b array<array<string>>").select(topics.aligned(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in lists] == pytest.approx([1.0, 0.5, 0.0, (0.5 + 0.5) / 2])
    assert math.isnan(topics.coherence(spark.createDataFrame([], "doc_id int, place int, token string"), spark.createDataFrame([(0, 0, "a")], "topic_id int, rank int, term string"))[1])
    docs = ["a b c a", "a c d e f g", "b d", "c"]
    toks = spark.createDataFrame([(i, k, w) for i, d in enumerate(docs) for k, w in enumerate(d.split())], "doc_id int, place int, token string")
    words = ["a", "b", "c", "zz"]
    top = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "topic_id int, rank int, term string")

    def windows(n):
        out = []
        for d in (d.split() for d in docs):
            out += [set(d[i : i + n]) for i in range(max(1, len(d) - n + 1))] if n else [set(d)]
        return out

    def npmi(w, x, y):
        n = len(w)
        p, q, r = (sum(f(s) for s in w) / n for f in (lambda s: x in s, lambda s: y in s, lambda s: x in s and y in s))
        return math.log((r + 1e-12) / (p * q)) / -math.log(r + 1e-12) if p and q else 0.0

    w = windows(3)
    want = [npmi(w, x, y) for x in words for y in words if x != y]
    assert topics.c_npmi(toks, top, 3).first()["c_npmi"] == pytest.approx(sum(want) / len(want))
    vectors = [[npmi(w, x, y) for y in words] for x in words]
    total = [sum(c) for c in zip(*vectors)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cosine = [sum(a * b for a, b in zip(v, total)) / (norm(v) * norm(total)) if norm(v) else 0.0 for v in vectors]
    assert topics.c_v(toks, top, 3).first()["c_v"] == pytest.approx(sum(cosine) / len(cosine))
    d = windows(None)
    n = lambda *x: sum(all(y in s for y in x) for s in d)
    mass = [math.log((n(words[i], words[j]) / 4 + 1e-12) / (n(words[j]) / 4)) for i in range(4) for j in range(i) if n(words[j])]
    assert topics.u_mass(toks, top).first()["u_mass"] == pytest.approx(sum(mass) / len(mass))
    model = spark.createDataFrame([(m, t, w) for m in (0, 1, 2) for t, ws in enumerate((["a", "b"], ["c", "d"])) for w in (ws if m < 2 else ["q"])], "model int, topic_id int, term string")
    got = topics.stability(model).first()
    assert (got["n_pairs"], got["mean"]) == (3, pytest.approx(1 / 3))


def test_coherence_deals_documents_by_their_tokens(spark, monkeypatch):
    """Partitions grow with the tokens, whatever the session's number is; counts are the same, with null and repeated ids, and texts aren't read again for them."""
    docs = [(1, "a b c a"), (2, "a c d e f g"), (3, "b d"), (None, "a b"), (3, "a"), (4, "c")]
    toks = spark.createDataFrame([(i, k, w) for i, d in docs for k, w in enumerate(d.split())], "doc_id int, place int, token string")
    top = spark.createDataFrame([(0, i, w) for i, w in enumerate("abz")] + [(1, i, w) for i, w in enumerate("ca")], "topic_id int, rank int, term string")
    read = lambda n: sorted(map(tuple, topics.pair_counts(toks, top, n).collect()))
    before, whole = read(3), read(None)
    monkeypatch.setattr(topics, "_TOKENS", 1)
    seen, _ = topics._covered(toks, top.select("term").distinct(), 3)
    assert "RepartitionByExpression [doc_id" in (plan := seen._jdf.queryExecution().optimizedPlan().toString()) and ", 17" in plan
    assert read(3) == before and read(None) == whole and ("a", "a", 0, 0, 0, 3.0, 3.0, 3.0, 5.0) in whole
    plan = topics.pair_counts(toks.where("rand() >= 0"), top, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in plan


def test_dictionary_limits(spark):
    rows = [(i, " ".join(w for w, n in (("four", 4), ("five", 5), ("eight", 8), ("nine", 9)) if i < n) + " gmbh") for i in range(10)]
    _, model = topics.prepared(spark.createDataFrame(rows, "doc_id int, clean_text string"))
    assert set(model.vocabulary) == {"five", "eight"}


def test_pipeline_writes_its_files(spark, tmp_path):
    parts = [blocks(spark, f"data/pdf/{c}/{f}", 10, 4) for c, f in (("SPAIN/ACME", "rep2020.pdf"), ("FRANCE/VINCI S.A", "AR19.pdf"))]
    every, pages = parts[0][0].union(parts[1][0]), parts[0][1].union(parts[1][1])
    dim = spark.createDataFrame([("FRANCE", "VINCI", 2019, "CSR")], "country string, company_norm string, year int, doc_type string")
    lists = {"positive": ["grow"], "negative": ["fall"], "hedges": ["may"]}
    topic = {"counts": (2,), "runs": 1, "max_iter": 2, "min_df": 1, "max_df": 1.0}
    out = pipeline.run(spark, str(tmp_path), blocks=every, pages=pages, dim=dim, run_topics=True, topic_options=topic, **lists)
    got = {r["document"]: r for r in out.collect()}
    assert got["AR19.pdf"]["doc_type"] == "CSR" and got["rep2020.pdf"]["doc_type"] == "Unknown" and got["rep2020.pdf"]["year"] == "2020"
    for name in ("processed_texts.csv", "results.csv", "coherence.csv", "topics/alpha_auto_n_topics_2_k_1/lda_topics_keywords.csv", "topics/alpha_auto_n_topics_2_k_1/lda_document_distribution.csv", "topics/alpha_auto_n_topics_2_k_1/dictionary_readable.txt"):
        assert any(Path(tmp_path, name).glob("part-*")), name
    header = next(p for p in Path(tmp_path, "results.csv").glob("part-*") if p.stat().st_size).read_text().splitlines()[0]
    assert header == ";".join(vocab.RESULT_COLUMNS.values())
    zones = readers.zone_files(spark, f"{tmp_path}/chunks_lexical")
    assert zones.count() == 2 and zones.where("size(zones) > 0 and relevant_text <> ''").count() == 2
    again = pipeline.run(spark, str(tmp_path / "again"), run_preproc=False, corpus_path=f"{tmp_path}/processed_texts.csv", dim=dim, **lists)
    assert {r["document"]: (round(r["idx"], 4), r["doc_type"]) for r in again.collect()} == {k: (round(r["idx"], 4), r["doc_type"]) for k, r in got.items()}
    assert pipeline.run(spark, str(tmp_path), run_preproc=False) is None


def test_readers(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# note\n Carbon \n\nsolar\ncarbon\n")
    assert readers.word_list(spark, str(tmp_path / "terms.txt")) == ["carbon", "solar"]
    assert readers.word_list(spark, str(tmp_path / "terms.txt"), comments=False)[1] == " Carbon "
    (tmp_path / "lm.csv").write_text("word,sentiment\nMAY,WeakModal\nmay,Uncertainty\ngood,Positive\n")
    assert scoring.hedge_words(readers.lexicon(spark, str(tmp_path / "lm.csv"))) == ["may"]
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "q" / "A.PDF").write_bytes(b"x")
    assert readers.pdf_files(spark, str(tmp_path / "p")).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.pdf_files(spark, str(tmp_path / "none")).count()
    (tmp_path / "s.csv").write_text("c,d,note,2018\nSpain,ACME,x,CSR\n")
    rows, years = readers.sheet(spark, str(tmp_path / "s.csv"))
    assert metadata.sheet_to_long(rows, "country", "company", years).first()["doc_type"] == "CSR"
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.zone_files(spark, str(tmp_path)).first()["relevant_text"] == ""


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    keywords = queries.KEYWORDS
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    schema = docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    q = landing.to_table(landing.landed(spark, str(tmp_path / "in"), schema), keywords, str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, landing.hot_lines(docs, keywords).collect())) != []


def test_zone_properties(spark):
    rows = queries.keyword_zones(spark, SF).orderBy("doc_id", "zone_id").collect()
    assert len(rows) == 30
    for a, b in zip(rows, rows[1:]):
        assert a["doc_id"] != b["doc_id"] or a["hi"] + 1 < b["lo"]


def test_entry_and_every_query_has_one_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_topic_models_read_all_documents_in_each_pass(spark):
    rows, _, model = queries._lda(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert model.getMaxIter() * model.getSubsamplingRate() == 50
