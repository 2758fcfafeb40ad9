"""Registered queries of the base engine and the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import lexical, metadata, passes, scoring, topics, variational
from ..operators import zones as Z

#: The tables hold invented words, so these stand in for a vocabulary and for lexicons.
VOCABULARY = ["rewh", "orre", "thatin", "ononst", "inoran", "hehely", "orantion"]
POSITIVE, NEGATIVE, HEDGES = ["the", "ing", "heat", "and"], ["of", "er", "thon", "der"], ["that", "with", "this", "from"]
FRAMEWORKS = {"percentages": r"\b\d+(?:[.,]\d+)?\s*%", "large_numbers": r"\b\d{4,}\b", "frameworks": r"\b(?:the|and)\b"}
TOPIC_WORDS = {0: ["the", "of", "and", "to"], 1: ["for", "that", "with", "thion"], 2: ["la", "de", "el", "que"]}
ALIASES = {"GERMANY": "DEUTSCHLAND", "FRANCE": "FRANCIA", "NATION#1": "ONE"}
KEYWORDS = T.keyword_pattern(VOCABULARY, [])


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", T.ascii_only(F.col("text")))


def _paras(spark: SparkSession, sf_dir: str, headings: bool = False) -> DataFrame:
    return Z.paragraphs(Z.line_units(_docs(spark, sf_dir), headings))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.spread(_ascii(spark, sf_dir)).select("doc_id", "source", "lang", F.posexplode(T.found(F.lower("text"), "[a-z]+")).alias("place", "token"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_block(F.col("text"))).alias("clean_md5"), F.length(T.clean_block(F.col("text"))).cast("long").alias("n"))


def paragraph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Z.counted(_paras(spark, sf_dir), KEYWORDS)
    return out.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "kw_count", "word_count", F.round("density", 4).alias("density"))


def hot_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.counted(_paras(spark, sf_dir), KEYWORDS).where("density >= 1.0").select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "kw_count")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.zones(_paras(spark, sf_dir), KEYWORDS)


def keyword_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return _zones(spark, sf_dir).select("doc_id", long("zone_id"), long("lo"), long("hi"), "start_char", "end_char", F.md5("text").alias("text_md5"), "kw_count", "word_count", "kw_density")


def zone_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of texts with headings, and the section that a zone's first paragraph is in."""
    out = Z.zones(_paras(spark, sf_dir, True), KEYWORDS)
    return out.select("doc_id", F.col("zone_id").cast("long").alias("zone_id"), "start_char", "end_char", F.md5("section").alias("section_md5"))


def zone_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zones(spark, sf_dir).select("doc_id", F.col("zone_id").cast("long").alias("zone_id"), F.array_join("keywords_found", ",").alias("keywords"))


def char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paras(spark, sf_dir).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "start_char", "end_char")


def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paras(spark, sf_dir, True).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.col("section_idx").cast("long").alias("section_idx"), F.md5("section").alias("section_md5"), "start_char")


def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of numbers made of lineitem: how many of each order look like tables."""
    item = _load(spark, sf_dir, "lineitem")
    line = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("quantity of the ordered part and its number ")).otherwise(F.lit("")), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(" orre")).otherwise(F.lit("")))
    return item.select("l_orderkey", T.is_table(line, KEYWORDS).alias("t")).groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if("t").alias("n_tables"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files, documents as pages, lines as blocks in the header band."""
    lines = _ascii(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return lines.withColumns({"btype": F.lit(0), "y0": F.lit(0.0), "y1": F.lit(1.0), "page_h": F.lit(100.0)})


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.running_blocks(_lines(spark, sf_dir), _docs(spark, sf_dir).select(F.col("source").alias("doc_id")))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir).select(F.col("doc_id").alias("source"), "key")


def anti_join_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("key", T.running_key(F.col("text"))).where("key <> ''")
    return lines.join(_running(spark, sf_dir), ["doc_id", "key"], "left_anti").groupBy(F.col("doc_id").alias("source")).agg(F.count("*").alias("n"))


def relevant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.relevant_text(_zones(spark, sf_dir)).select("doc_id", "n_zones", F.md5("relevant_text").alias("text_md5"))


def year_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of file names made of order keys."""
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("rep"), 2000 + key % 40, F.lit(".pdf"))).when(key % 4 == 1, F.concat(F.lit("AR"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(".pdf"))).when(key % 4 == 2, F.concat(F.lit("x1"), key % 1000, F.lit("0345"))).otherwise(F.concat(F.lit("foo"), key % 7))
    year = T.year_of_name(F.col("name"))
    return _load(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", "name", year.alias("year"), T.year_number(year).alias("year_number"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import with_path_parts

    return with_path_parts(_load(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "document", "company", "country")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("2018"), F.col("toxic").cast("string").alias("2019"))
    return wide.unpivot(["doc_id"], ["2018", "2019"], "year", "value").select("doc_id", T.year_number(F.col("year")).alias("year"), T.cell(F.col("value")).alias("doc_type"))


def doc_type_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(spark, sf_dir)


def doc_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _types(spark, sf_dir).select(F.lit("X").alias("country"), F.col("doc_id").cast("string").alias("company_norm"), "year", "doc_type")
    docs = _docs(spark, sf_dir).select("doc_id", F.lit("x ").alias("country"), F.col("doc_id").cast("string").alias("company"), F.when(F.col("doc_id") % 2 == 0, "2018").otherwise("2019.0").alias("year"))
    return metadata.with_doc_type(docs, dim).select("doc_id", "doc_type")


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "nation").select("n_nationkey", T.alias(F.upper(T.strip(F.col("n_name"))), ALIASES).alias("name"))


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.with_normal(_load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", "name").select("s_suppkey", "name")


def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lexical.kept_tokens(_tokens(spark, sf_dir), HEDGES, None, NEGATIVE + POSITIVE)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("lemma").alias("n_distinct"))


def quant_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.quant(_ascii(spark, sf_dir), FRAMEWORKS).select("doc_id", F.round("quant", 6).alias("quant"))


def hedge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hedge(_ascii(spark, sf_dir), HEDGES).select("doc_id", F.round("hedge", 6).alias("hedge"))


def tfidf_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breadth(_ascii(spark, sf_dir), VOCABULARY + HEDGES).select("doc_id", F.round("sus", 6).alias("sus"))


def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.polarity(_ascii(spark, sf_dir), POSITIVE, NEGATIVE).select("doc_id", F.round("sen", 6).alias("sen"))


def polarity_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.polarity(_ascii(spark, sf_dir), POSITIVE, NEGATIVE, stem=True).select("doc_id", F.round("sen", 6).alias("sen"))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.zscores(_load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("z_c_acctbal", 6).alias("z"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_ascii(spark, sf_dir).select("doc_id", "text"), VOCABULARY + HEDGES, POSITIVE, NEGATIVE, HEDGES, FRAMEWORKS)


def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("idx", 4).alias("idx"), "label")


def composite_index_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("idx_ext", 4).alias("idx_ext"), "label_ext")


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.flag_summary(_scored(spark, sf_dir))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).agg((F.count("*") * 0.85).alias("most"))
    return topics.document_frequency(_tokens(spark, sf_dir)).crossJoin(F.broadcast(n)).where((F.col("df") >= 5) & (F.col("df") <= F.col("most"))).select("token", "df")


def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.bag_of_words(_tokens(spark, sf_dir))


def topk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.ranked_terms(_tokens(spark, sf_dir), "lang", 20).select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


def topic_pair_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = topics.topic_sets(topics.ranked_terms(_tokens(spark, sf_dir), "source", 10).withColumnRenamed("token", "term"), ["source"])
    return topics.pair_jaccard(sets, "source").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def dominant_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of each embedding's greatest component, the first of equal ones."""
    return _load(spark, sf_dir, "embeddings").select("vec_id", topics.dominant(F.col("embedding")).cast("long").alias("dominant"))


def _fixed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, w) for k, ws in TOPIC_WORDS.items() for i, w in enumerate(ws)], "topic_id int, rank int, term string")


def coherence_umass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.u_mass(_tokens(spark, sf_dir), _fixed(spark)).select("topic_id", F.round("u_mass", 6).alias("u_mass"))


def coherence_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.c_npmi(_tokens(spark, sf_dir), _fixed(spark)).select("topic_id", F.round("c_npmi", 6).alias("c_npmi"))


def coherence_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.c_v(_tokens(spark, sf_dir), _fixed(spark)).select("topic_id", F.round("c_v", 6).alias("c_v"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.spread(_ascii(spark, sf_dir)).select("doc_id", F.coalesce(F.lower("text"), F.lit("")).alias("clean_text"))


def _corpus(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    return topics.prepared(_clean(spark, sf_dir))


def _lda(spark: SparkSession, sf_dir: str, seed: int = 1, mixtures: bool = False):  # noqa: ANN202
    """(rows, mixtures of all documents if asked for, model)."""
    rows, words = _corpus(spark, sf_dir)
    with passes.Corpus(rows, words) as corpus:
        model = corpus.fit(4, seed=seed)
        return rows, corpus.mixtures(model) if mixtures else None, model


def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.top_terms(_lda(spark, sf_dir)[2], spark, 10)


def lda_doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.wide(_lda(spark, sf_dir, mixtures=True)[1], 4)


def aligned_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words = _corpus(spark, sf_dir)
    return topics.compute_stability(rows, words, 4, 2, 10)


#: Weights of the topic words in each topic, by rank, and of words of other topics.
TOPIC_WEIGHTS, OTHER_WEIGHT = [0.4, 0.3, 0.2, 0.1], 0.01
FOLD_ALPHA, FOLD_STEPS, PASSES, ETA = [0.5, 0.3, 0.2], 50, 3, 0.1


def _topic_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, n) of the topic words: the other tokens go before the rows are grouped."""
    words = sorted({w for ws in TOPIC_WORDS.values() for w in ws})
    toks = scoring.spread(_ascii(spark, sf_dir)).select("doc_id", F.explode(T.found(F.lower("text"), "[a-z]+")).alias("term"))
    return topics.bag_of_words(toks.where(F.col("term").isin(words)), "term")


def _topic_table() -> list[tuple[str, list[float]]]:
    return [(w, [TOPIC_WEIGHTS[i] if t == k else OTHER_WEIGHT for t in TOPIC_WORDS]) for k, ws in TOPIC_WORDS.items() for i, w in enumerate(ws)]


def topic_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic mixtures of all documents against fixed topics; those without a topic word have the prior's."""
    out = variational.folded_in(_topic_bags(spark, sf_dir), spark.createDataFrame(_topic_table(), "term string, weights array<double>"), FOLD_ALPHA, FOLD_STEPS, _docs(spark, sf_dir))
    return out.select("doc_id", "dominant_topic", *[F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(len(FOLD_ALPHA))])


def _trained(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Passes over all documents from a stored table of topics."""
    from ..sources import sinks

    words = spark.createDataFrame([(i, w, x) for i, (w, x) in enumerate(_topic_table())], "term_id int, term string, weights array<double>")
    bags = _topic_bags(spark, sf_dir).join(F.broadcast(words), "term").select("doc_id", "term_id", "n")  # a few words for each topic
    path = sinks.scratch(spark, "passes")
    variational.train(variational.documents(bags, len(FOLD_ALPHA)), words.select("term_id", "weights"), path, PASSES, FOLD_ALPHA, ETA)
    return path, words


def lda_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence bound of each pass."""
    return variational.bounds(spark, _trained(spark, sf_dir)[0]).select(F.col("pass").cast("long").alias("pass"), F.round("bound", 3).alias("bound"), "n_docs")


def lda_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics after the last pass."""
    path, words = _trained(spark, sf_dir)
    made = variational.trained_topics(spark, path, PASSES).join(words.select("term_id", "term"), "term_id")
    return made.select("term", F.posexplode("weights").alias("topic_id", "weight")).select("term", "topic_id", F.round("weight", 6).alias("weight"))


#: Phrases that hold terms, each of the extra patterns, and near misses.
PHRASES = ["Carbon emissions", "CO2e and CO2", "scope 3", "scope two", "water stewardship", "social impact", "energy mix", "human rights", "human-rights", "net zero", "circular economy", "Paris  agreement", "health and safety", "employee wellness", "supply chain risk", "responsible sourcing", "double materiality", "transition plan", "renewable energy", "wind power", "tonnes co2", "science-based targets", "UN SDG", "sustainably", "decarbonised", "recycling", "offsetting", "social energy", "scope 4", "esgs", "netzero", "plain words"]


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, key = F.array(*[F.lit(x) for x in PHRASES]), F.col("o_orderkey")
    pick = lambda n: F.get(held, ((key * n) % len(PHRASES)).cast("int"))
    return _load(spark, sf_dir, "orders").select("o_orderkey", F.concat(pick(1), F.lit(" with "), pick(7), F.when(key % 2 == 0, "\n\n").otherwise(" "), pick(11)).alias("text"))


def keyword_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the whole default vocabulary, terms and extra patterns, in phrases made of order keys."""
    hits = F.col("hits")
    out = T.once(_phrases(spark, sf_dir), "hits", T.found(F.col("text"), T.trie_pattern()))
    return out.select("o_orderkey", F.size(hits).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform(hits, F.lower))), ",").alias("keywords"))


#: A vocabulary of 5,202 terms is made of two and three of these.
SYLLABLES = ["the", "ing", "and", "of", "er", "re", "wh", "on", "in", "or", "an", "ti", "en", "ed", "ha", "nt", "th"]
MANY_TERMS = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in ["", *SYLLABLES]]


def keyword_large_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a vocabulary of thousands of terms in all documents."""
    hits = F.col("hits")
    out = T.once(scoring.spread(_ascii(spark, sf_dir)), "hits", T.found(F.col("text"), T.trie_pattern(MANY_TERMS, [])))
    keywords = F.array_sort(F.array_distinct(F.transform(hits, F.lower)))
    return out.select("doc_id", F.size(hits).cast("long").alias("n"), F.size(keywords).cast("long").alias("n_distinct"), F.md5(F.array_join(keywords, ",")).alias("keywords_md5"))


#: Stands in for a table of lemmas, which the tables don't hold.
LEMMA = "case when length(token) > 5 and token like '%ies' then substr(token, 1, length(token) - 3) || 'y' when length(token) > 5 and token like '%ing' then substr(token, 1, length(token) - 3) when length(token) > 4 and token like '%ed' then substr(token, 1, length(token) - 1) when length(token) > 3 and token like '%s' and token not like '%ss' then substr(token, 1, length(token) - 1) else token end"
UNSEEN = "substr(md5(token), 1, 1) in ('0', '1', '2')"


def lemma_suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of all tokens, where the pairs of some are held out: those get theirs by suffix rules that the others teach."""
    pairs = _tokens(spark, sf_dir).select("token").where("length(token) > 2").distinct().selectExpr("token", f"{LEMMA} as true_lemma", f"{UNSEEN} as held_out")
    pairs = scoring.stored(pairs, "pairs")  # read several times, and the texts only once
    made = lexical.lemma_table(pairs, pairs.where("not held_out").withColumnRenamed("true_lemma", "lemma"))
    return pairs.join(made, "token").select("token", "held_out", "true_lemma", "lemma")


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of pages: two lines are a block, ten blocks a page. The first block of a page is a running header, which some pages repeat in the body; lines of some documents are short."""
    lines = F.split("text", "\n")
    cut = lambda x: F.when(F.col("doc_id") % 5 == 0, F.substring(x, 1, 40)).otherwise(x)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lines) / 2).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.transform(F.slice(lines, i * 2 + 1, 2), cut), "\n"))
    held = _ascii(spark, sf_dir).select("doc_id", F.posexplode(pairs).alias("block_no", "raw"))
    held = held.withColumns({"page_no": F.floor(F.col("block_no") / 10).cast("int"), "at": F.col("block_no") % 10})
    head = F.concat(F.lit("Report page "), F.col("page_no").cast("string"))
    text = F.when((F.col("at") == 0) | ((F.col("at") == 5) & (F.col("doc_id") % 3 == 0)), head).when((F.col("at") == 3) & (F.col("doc_id") % 2 == 0), "SECTION HEADING").when(F.col("at") == 7, F.concat(F.lit("12 345 "), F.col("doc_id").cast("string"))).otherwise(F.col("raw"))
    y = F.col("at") * F.lit(83.0)
    blocks = held.select("doc_id", "page_no", "block_no", ((F.col("block_no") * 7) % 3).cast("double").alias("x0"), y.alias("y0"), (y + 50.0).alias("y1"), text.alias("text"), F.when(F.col("block_no") % 13 == 12, 1).otherwise(0).alias("btype"), F.lit(800.0).alias("page_h"))
    return blocks, blocks.select("doc_id", "page_no").distinct()


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of page blocks: reading order, bands, running headers, tables of one and two lines, headings, offsets, sections."""
    out = Z.paragraphs(Z.units(*_blocks(spark, sf_dir), KEYWORDS))
    return out.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.md5("text").alias("text_md5"), "start_char", "end_char", F.col("section_idx").cast("long").alias("section_idx"), "section")


def metadata_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of a sheet made of suppliers: rows without a country go, so do columns of no year; the last row of a key counts."""
    k = F.col("s_suppkey")
    cell = lambda n: F.when(k % n == 0, "0").when(k % n == 1, F.concat(F.lit(" type "), (k % 9).cast("string"), F.lit(" ")))
    sheet = _load(spark, sf_dir, "supplier").select(F.when(k % 11 != 0, F.concat(F.lit(" land "), (k % 3).cast("string"))).alias("country"), F.concat(F.lit("Société  n.º "), (k % 7).cast("string"), F.lit(", S.A.")).alias("company"), F.lit("x").alias("note"), cell(2).alias("2018"), cell(3).alias("2019.0"), cell(4).alias("1999"))
    return metadata.dimension(metadata.sheet_to_long(sheet.coalesce(1), "country", "company", ["note", "2018", "2019.0", "1999"]))


COMPANIES = ["Vinci S.A", "BBVA", "l'Oréal s.a.", "Grupo ING, NV", "Infineon Technologies AG", "total  S A", "Unknown & Sons", "AXA S.A"]


def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("int")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), F.floor(k / n).cast("int") % len(xs))
    rows = _load(spark, sf_dir, "customer").select("c_custkey", pick([" españa", "Alemania", "Chile "], 1).alias("country"), pick(COMPANIES, 3).alias("company"))
    return metadata.with_keys(rows).select("c_custkey", "country_key", "company_norm")


STOP = ["the", "and", "that"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("data/pdf/"), "lang", F.lit("/"), "source", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "rep").when(F.col("doc_id") % 3 == 1, "AR").otherwise("x"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return _ascii(spark, sf_dir).select("doc_id", path.alias("path"), F.col("text").alias("relevant_text"))


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean texts without stop-words, with the parts and the year of a path."""
    from .pipeline import preprocess

    return preprocess(_texts(spark, sf_dir), stop_words=STOP).select("doc_id", "document", "country", "company", "year", "doc_type", F.md5("clean_text").alias("clean_md5"))


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus file as written and read again; names without a year keep theirs."""
    from ..sources import sinks
    from .pipeline import preprocess, reloaded

    path = sinks.scratch(spark, "corpus")
    sinks.corpus(preprocess(_texts(spark, sf_dir), stop_words=STOP), path)
    return reloaded(spark, path).select("document", "country", "company", "year", "doc_type", F.md5("clean_text").alias("clean_md5"))


def zone_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone files as written at the paths that mirror the documents' own, and read again; place is that under the root."""
    from ..sources import readers, sinks

    path = sinks.scratch(spark, "zones")
    files = readers.with_path_parts(_docs(spark, sf_dir).select("doc_id", F.concat(F.lit("data/pdf/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")))
    sinks.zones(_zones(spark, sf_dir), files, path)
    first = lambda c: F.get(F.col(f"zones.{c}"), F.lit(0))
    return readers.zone_files(spark, path).select("file", "path", F.regexp_extract("json_path", "(data/.*)$", 1).alias("zone_path"), F.size("zones").cast("long").alias("n_zones"), first("source").alias("zone_source"), first("section").alias("section"), F.md5("relevant_text").alias("text_md5"))


def zones_of_landing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword zones of all documents, whose pages of ten lines land in files of their own and in several batches."""
    from ..sources import sinks
    from ..streaming import landing

    source, path, checkpoint = (sinks.scratch(spark, name) for name in ("pages", "landed-zones", "landing"))
    lines = F.split("text", "\n")
    n = F.ceil(F.size(lines) / 10).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(lines, i * 10 + 1, 10), "\n"))
    pages = _docs(spark, sf_dir).where("text is not null").select("doc_id", n.alias("n_pages"), F.posexplode(cut).alias("page_no", "text"))
    pages.select("doc_id", "page_no", "n_pages", "text").repartition(6, F.xxhash64("doc_id", "page_no")).write.parquet(source)
    landing.zones_to_table(spark.readStream.schema(landing.PAGES).option("maxFilesPerTrigger", 3).parquet(source), KEYWORDS, path, checkpoint).awaitTermination()
    long = lambda c: F.col(c).cast("long").alias(c)
    return spark.read.parquet(path).select("doc_id", long("zone_id"), long("lo"), long("hi"), "start_char", "end_char", F.md5("text").alias("text_md5"), "kw_count", "word_count", "kw_density")


def zone_file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as if they were zone files: each third one is broken off, each fifth has another key."""
    from ..sources import readers, sinks

    path, k = sinks.scratch(spark, "broken"), F.col("page_id")
    whole = F.concat(F.lit('{"'), F.when(k % 5 == 0, "text").otherwise("relevant_text"), F.lit('": "'), F.col("url"), F.lit('"}'))
    rows = _load(spark, sf_dir, "pages").withColumn("t", whole).select(F.when(k % 3 == 0, F.substring("t", 1, 20)).otherwise(F.col("t")).alias("value"), k.alias("page"))
    scoring.spread(rows).write.partitionBy("page").option(*sinks.PARALLEL_COMMIT).text(path)
    out = readers.zone_file_texts(spark, path, "*.txt")
    return out.select(F.regexp_extract("json_path", r"page=(\d+)/", 1).cast("long").alias("page_id"), "relevant_text", F.coalesce("reason", F.lit("")).alias("reason"))


def result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import sinks

    path = sinks.scratch(spark, "results")
    blank = {c: F.lit("") for c in ("country", "company", "year", "doc_type")}
    sinks.results(_scored(spark, sf_dir).withColumns(blank).withColumn("document", F.col("doc_id").cast("string")), path)
    names = {c: a for a, c in vocab.RESULT_COLUMNS.items()}
    rows = spark.read.option("sep", ";").option("header", True).csv(path).withColumnsRenamed(names)
    return rows.select(F.col("document").cast("long").alias("doc_id"), F.col("sen").cast("double").alias("sen"), F.col("idx").cast("double").alias("idx"), F.col("label"))


WORDS_FILE = ["# a note", " Carbon ", "", "solar", "carbon", "Wind"]
LEXICON = [("THAT", "WeakModal"), ("with", "Uncertainty"), ("this", "Constraining"), ("from", "StrongModal"), ("from", "Uncertainty"), ("the", "Positive")]


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list and the hedging words of a lexicon, as written and read again."""
    from ..sources import readers, sinks

    lists, lexicon = sinks.scratch(spark, "list"), sinks.scratch(spark, "lexicon")
    spark.createDataFrame([(w,) for w in WORDS_FILE], "value string").coalesce(1).write.text(lists)
    spark.createDataFrame(LEXICON, "word string, sentiment string").write.option("header", True).csv(lexicon)
    kinds = {"terms": readers.word_list(spark, lists), "lines": readers.word_list(spark, lists, comments=False), "hedges": scoring.hedge_words(readers.lexicon(spark, lexicon))}
    return spark.createDataFrame([(k, w) for k, ws in kinds.items() for w in ws], "list string, word string")


def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the topic corpus, with all words in it."""
    return topics.words_of(topics.topic_tokens(_clean(spark, sf_dir)))


def _model_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return topics.ranked_terms(_tokens(spark, sf_dir), "source", 10).select((n % 3).alias("model"), F.floor(n / 3).cast("int").alias("topic_id"), F.col("token").alias("term"))


def topic_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as topics of three models."""
    return topics.stability(_model_topics(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_pairs")


def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topics.ranked_terms(_tokens(spark, sf_dir), "lang", 5).select(F.col("lang").alias("topic_id"), "rank", F.col("token").alias("term"), (F.col("n") / 1000.0).alias("weight"))
    return topics.keywords_table(top)


def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("probabilities"))
    return topics.wide(rows.withColumn("dominant_topic", topics.dominant(F.col("probabilities"))), 3)


_ALL = (keyword_pattern_hits, keyword_large_vocabulary, lemma_suffix_rules, page_units, metadata_dimension, company_keys, preprocessed, corpus_round_trip, zone_file_round_trip, zones_of_landing_pages, zone_file_errors, result_round_trip, word_lists, dictionary_terms, topic_stability, topic_keywords, topic_distribution, clean_text, paragraph_density, hot_paragraphs, keyword_zones, zone_sections, zone_keywords, char_offsets, section_carry, table_filter, running_lines, anti_join_running, relevant_text, year_from_name, path_parts, doc_type_unpivot, doc_type_lookup, alias_lookup, name_normalize, token_filter, quant_density, hedge_density, tfidf_breadth, polarity, polarity_stemmed, zscore, composite_index, composite_index_ext, flag_summary, doc_frequency, bag_of_words, topk_terms, topic_pair_jaccard, dominant_topic, coherence_umass, coherence_npmi, coherence_cv, topic_fold_in, lda_bound, lda_trained, lda_topics, lda_doc_topics, aligned_stability)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_WS = r"[\t-\r\x1c-\x20]"
_KW = KEYWORDS.replace("'", "''")
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{}}, 'https?://\S+|www\.\S+', '', 'g'), '(\w+)-\n(\w+)', '\1\2', 'g'), '[^\x00-\x7F]', '', 'g'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"
_UNITS = f"""
ln as (select doc_id, unnest(l) as raw, unnest(range(len(l))) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents)),
un as (select doc_id, line_no, t as text, {{marker}} as is_marker from (select doc_id, line_no, {_CLEAN.format('raw')} as t from ln) where t <> ''),
us as (select *, len(text) + case when is_marker then 4 else 0 end as size, row_number() over (partition by doc_id order by line_no) as u from un),
pa as (select doc_id, text, u, is_marker, cast(coalesce(sum(size + 2) over (partition by doc_id order by u rows between unbounded preceding and 1 preceding), 0) as bigint) as start_char,
  cast(sum(is_marker::int) over (partition by doc_id order by u) as bigint) - 1 as section_idx, coalesce(last_value(case when is_marker then text end ignore nulls) over (partition by doc_id order by u rows between unbounded preceding and current row), '') as section from us),
p as (select *, start_char + len(text) as end_char, row_number() over (partition by doc_id order by u) - 1 as para_idx from pa where not is_marker)"""
_PARAS = _UNITS.format(marker="false")
_LETTERS = "regexp_replace(t, '[^a-zA-Z]', '', 'g')"
_WORDS = "list_filter(regexp_split_to_array({}, '" + _WS + "+'), lambda x: x <> '')"
_HEADING = f"(len({_LETTERS}) >= 2 and {_LETTERS} = upper({_LETTERS}) and len({_WORDS.format('t')}) <= 10 and len(list_filter({_WORDS.format('t')}, lambda x: len(regexp_replace(x, '[^a-zA-Z]', '', 'g')) <= 1)) / len({_WORDS.format('t')}) < 0.60 and not regexp_matches(t, '\\b\\w[\\w-]*\\.\\w{{2,6}}\\b'))"
_HITS = f"len(regexp_extract_all({{}}, '{_KW}'))"
_COUNTED = f"{_PARAS}, c as (select *, cast({_HITS.format('text')} as bigint) as kw_count, cast(len({_WORDS.format('text')}) as bigint) as word_count from p), h as (select *, case when word_count > 0 then kw_count / word_count * 100 else 0.0 end as density from c)"
_ZONES = f"""{_COUNTED},
k as (select *, max((density >= 1.0)::int) over (partition by doc_id order by para_idx rows between 1 preceding and 1 following) as kept from h),
g as (select *, para_idx - row_number() over (partition by doc_id order by para_idx) as run from k where kept = 1),
z0 as (select doc_id, run, string_agg(text, chr(10) || chr(10) order by para_idx) as text, min(para_idx) as lo, max(para_idx) as hi, min(start_char) as start_char, max(end_char) as end_char from g group by doc_id, run),
z1 as (select *, row_number() over (partition by doc_id order by start_char) - 1 as zone_id, cast({_HITS.format('text')} as bigint) as kw_count, cast(len({_WORDS.format('text')}) as bigint) as word_count from z0 where len(text) >= 150),
z as (select *, round(case when word_count > 0 then kw_count / word_count * 100 else 0.0 end, 4) as kw_density from z1)"""
_TOK = f"tk as (select doc_id, source, lang, unnest(w) as token, unnest(range(len(w))) as place, len(w) as n_tokens from (select doc_id, source, lang, regexp_extract_all(lower({_ASCII}), '[a-z]+') as w from documents))"


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_TERMS = VOCABULARY + HEDGES
_COMPONENTS = f"""
dd as (select doc_id, {_ASCII} as text from documents),
hits as (select doc_id, unnest(regexp_extract_all(lower(text), '\\b(?:{'|'.join(sorted(_TERMS, key=len, reverse=True))})\\b')) as term from dd),
tf as (select doc_id, term, count(*) as tf from hits group by all),
idf as (select term, ln((1 + (select count(*) from dd)) / (1 + count(*))) + 1 as idf from tf group by term),
su as (select doc_id, sum(tf * idf) / sqrt(sum(tf * idf * tf * idf)) / {len(_TERMS)} as sus from tf join idf using (term) group by doc_id),
ws as (select doc_id, text, regexp_extract_all(lower(text), '[a-z]+') as t, {_WORDS.format('text')} as w from dd),
co as (select doc_id, coalesce(sus, 0.0) as sus,
  (len(list_filter(t, lambda x: x in {_in(POSITIVE)})) - len(list_filter(t, lambda x: x in {_in(NEGATIVE)}))) / (len(list_filter(t, lambda x: x in {_in(POSITIVE)})) + len(list_filter(t, lambda x: x in {_in(NEGATIVE)})) + 1e-6::double) as sen,
  ({' + '.join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in FRAMEWORKS.values())}) / greatest(len(w), 1) as quant,
  len(list_filter(w, lambda x: lower(x) in {_in(HEDGES)})) / greatest(len(w), 1) as hedge from ws left join su using (doc_id))"""
_Z = lambda c: f"case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0.0 end"
_INDEX = f"""{_COMPONENTS},
zs as (select doc_id, {_Z('sen')} as zsen, {_Z('sus')} as zsus, {_Z('quant')} as zq, {_Z('hedge')} as zh from co),
ix as (select doc_id, zsen - zsus as idx, zsen - zsus - 0.5 * zq + 0.5 * zh as idx_ext from zs)"""
_RUN = rf"""
lr as (select source, regexp_replace(regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g'), '[0-9]+', '#', 'g') as key, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') as t from (select source, unnest(string_split({_ASCII}, chr(10))) as raw from documents)),
np as (select source, count(*) as n_pages from documents group by source),
rn as (select source, key from (select source, key, count(*) as n from lr where t <> '' and len(t) <= 120 group by all) join np using (source) where n / n_pages > 0.30)"""
_TOPICS = "tp as (select * from (values " + ", ".join(f"({k}, {i}, '{w}')" for k, ws in TOPIC_WORDS.items() for i, w in enumerate(ws)) + ") as v(topic_id, rank, term))"


def _coherence(window: int | None) -> str:
    last = f"greatest(n_tokens - {window}, 0)" if window else "0"
    span = f"unnest(range(greatest(place - {(window or 1) - 1}, 0), least(place, {last}) + 1))" if window else "0"
    return f"""{_TOK}, {_TOPICS},
to_ as (select cast(sum(n) as double) as total from (select doc_id, max({last}) + 1 as n from tk group by doc_id)),
sw as (select distinct doc_id, token, {span} as s from tk where token in (select term from tp)),
ni as (select token, cast(count(*) as double) as n from sw group by token),
nn as (select a.token as wi, b.token as wj, cast(count(*) as double) as n from sw a join sw b using (doc_id, s) group by all),
pr as (select a.topic_id, a.rank as i, b.rank as j, coalesce(x.n, 0) as ni, coalesce(y.n, 0) as nj, coalesce(nn.n, 0) as nij, total from tp a join tp b using (topic_id) left join nn on nn.wi = a.term and nn.wj = b.term left join ni x on x.token = a.term left join ni y on y.token = b.term, to_),
pm as (select *, case when ni > 0 and nj > 0 then ln((nij / total + 1e-12::double) / (ni / total * (nj / total))) / -ln(nij / total + 1e-12::double) else 0.0 end as v from pr)"""


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _forms(words: list[str]) -> list[str]:
    """Words that have the stem of one of these: it and up to two endings."""
    ends = ["", "s", "es", "e", "ed", "ing", "er", "ers", "ly", "al", "ful", "ness", "ment", "able", "ible", "ant", "ent", "ion", "ions", "ation", "ism", "ate", "ous", "ive", "ize", "y", "ies", "ied", "i", "ance", "ence", "ic", "ical", "ous", "ement", "iti", "or"]
    stems = {lexical.porter_stem(w) for w in words}
    bases = stems | {s + s[-1] for s in stems} | set(words)
    return sorted({c for b in bases for x in ends for y in ends if lexical.porter_stem(c := b + x + y) in stems})


def _psi(x: str) -> str:
    """The derivative of ln gamma: ten steps up, then the series."""
    y = f"({x} + 10.0::double)"
    rise = " + ".join(f"1 / ({x} + {j}.0::double)" for j in range(10))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - ({rise}))"


def _variational_sql() -> dict[str, str]:
    """Inference and passes as recursive queries: r is a document's mixture after i rounds."""
    doubles = lambda xs: "[" + ", ".join(f"{x}::double" for x in xs) + "]"
    k, alpha = len(FOLD_ALPHA), doubles(FOLD_ALPHA)
    table = "tw as (select * from (values " + ", ".join(f"({i}, '{w}', {doubles(x)})" for i, (w, x) in enumerate(_topic_table())) + ") as v(term_id, term, w))"
    places = f"range(1, {k + 1})"

    def rounds(name: str, bag: str, start: str, steps: int) -> str:
        return f"""{name}(doc_id, i, bag, g) as (select doc_id, 0, bag, {start} union all
select doc_id, i + 1, bag, list_transform({places}, lambda k: {alpha}[k] + th[k] * coalesce(list_sum(list_transform(bag, lambda x: x.n * x.w[k] / (list_dot_product(th, x.w) + 1e-100::double))), 0))
from (select *, list_transform(g, lambda y: exp({_psi("y")})) as th from {name} where i < {steps}))"""

    counts = f"{_TOK}, {table}, bg as (select doc_id, term_id, w, cast(count(*) as double) as n from tk join tw on token = term group by all)"
    fold = f"with recursive {counts}, dl as (select d.doc_id, coalesce(bag, []) as bag from documents d left join (select doc_id, list({{'n': n, 'w': w}} order by term_id) as bag from bg group by doc_id) using (doc_id)), {rounds('r', 'bag', doubles([1] * k) + ' from dl', FOLD_STEPS)}, p as (select doc_id, list_transform(g, lambda y: y / list_sum(g)) as p from r where i = {FOLD_STEPS}) select doc_id, cast(list_position(p, list_max(p)) - 1 as integer) as dominant_topic, " + ", ".join(f"round(p[{i + 1}], 6) as p{i}" for i in range(k)) + " from p"
    parts, n_terms = [f"with recursive {counts}, w0 as (select term_id, w from tw)"], len(_topic_table())
    per_topic = lambda f: "[" + ", ".join(f(i + 1) for i in range(k)) + "]"
    psi = lambda expr, var: f"list_transform({expr}, lambda {var}: {_psi(var)})"
    for p in range(1, PASSES + 1):
        start = doubles([1] * k) if p == 1 else "g"
        source = f"from l{p}" if p == 1 else f"from l{p} join (select doc_id, g from r{p - 1} where i = {variational.PASS_STEPS}) using (doc_id)"
        parts += [
            f"t{p} as (select {per_topic(lambda i: f'sum(w[{i}])')} as t from w{p - 1})",
            f"e{p} as (select term_id, w, list_transform({places}, lambda k: q[k] - z[k]) as lb from (select term_id, w, {psi('w', 'y')} as q, {psi('t', 'y')} as z from w{p - 1}, t{p}))",
            f"l{p} as (select doc_id, list({{'n': n, 't': term_id, 'w': list_transform(lb, lambda y: exp(y))}} order by term_id) as bag from bg join e{p} using (term_id) group by doc_id)",
            rounds(f"r{p}", "bag", f"{start} {source}", variational.PASS_STEPS),
            f"x{p} as (select doc_id, bag, g, list_transform({psi('g', 'y')}, lambda y: y - {_psi('list_sum(g)')}) as lt from r{p} where i = {variational.PASS_STEPS})",
            f"y{p} as (select doc_id, unnest(bag) as x, list_transform(lt, lambda y: exp(y)) as th from x{p})",
            f"w{p} as (select term_id, {per_topic(lambda i: f'coalesce(s[{i}], 0) + {ETA}::double')} as w from w{p - 1} left join (select x.t as term_id, {per_topic(lambda i: f'sum(x.n * th[{i}] * x.w[{i}] / (list_dot_product(th, x.w) + 1e-100::double))')} as s from y{p} group by x.t) using (term_id))",
            f"""b{p} as (select (select sum(x.n * ln(list_dot_product(th, x.w) + 1e-100::double)) from y{p})
  + (select sum(list_sum(list_transform({places}, lambda k: ({alpha}[k] - g[k]) * lt[k] + lgamma(g[k]) - lgamma({alpha}[k]))) + lgamma(list_sum({alpha})) - lgamma(list_sum(g))) from x{p})
  + (select sum(list_sum(list_transform({places}, lambda k: ({ETA}::double - w[k]) * lb[k] + lgamma(w[k]) - lgamma({ETA}::double)))) from e{p})
  + (select list_sum(list_transform(t, lambda y: lgamma({ETA * n_terms}::double) - lgamma(y))) from t{p}) as bound)""",
        ]
    bound = ", ".join(parts) + " " + " union all ".join(f"select cast({p} as bigint) as pass, round(bound, 3) as bound, (select count(*) from x{p}) as n_docs from b{p}" for p in range(1, PASSES + 1))
    trained = ", ".join(parts) + f" select term, cast(k - 1 as integer) as topic_id, round(w[k] / t[k], 6) as weight from (select term, z.w, s.t, unnest({places}) as k from w{PASSES} z join tw using (term_id), (select {per_topic(lambda i: f'sum(w[{i}])')} as t from w{PASSES}) s)"
    return {"topic_fold_in": fold, "lda_bound": bound, "lda_trained": trained}


def _more_sql() -> dict[str, str]:
    ws, name = _WS, lambda c: f"trim(regexp_replace(regexp_replace(strip_accents(upper(trim({c}))), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
    cell = lambda n: f"case when s_suppkey % {n} = 1 then 'type ' || (s_suppkey % 9) end"
    stripped = lambda c: f"regexp_replace({c}, '^{ws}+|{ws}+$', '', 'g')"
    short = stripped("x")
    blocks = f"""
bl0 as (select doc_id, string_split({_ASCII}, chr(10)) as l from documents),
bl1 as (select doc_id, unnest(range(cast(ceil(len(l) / 2) as bigint))) as block_no, l from bl0),
bl2 as (select doc_id, block_no, block_no // 10 as page_no, block_no % 10 as pos, array_to_string(list_transform(l[2 * block_no + 1 : 2 * block_no + 2], lambda x: case when doc_id % 5 = 0 then substr(x, 1, 40) else x end), chr(10)) as raw from bl1),
bl as (select doc_id, block_no, page_no, pos * 83.0 as y0, pos * 83.0 + 50 as y1, (block_no * 7) % 3 as x0, block_no % 13 = 12 as image,
  {stripped("case when pos = 0 or pos = 5 and doc_id % 3 = 0 then 'Report page ' || page_no when pos = 3 and doc_id % 2 = 0 then 'SECTION HEADING' when pos = 7 then '12 345 ' || doc_id else raw end")} as t from bl2),
np as (select doc_id, count(distinct page_no) as n_pages from bl group by doc_id),
bd as (select *, (y1 < 64 or y0 > 736) as band, regexp_replace(t, '[0-9]+', '#', 'g') as key from bl where not image),
rn as (select doc_id, key from (select doc_id, key, count(*) as n from bd where band and t <> '' and len(t) <= 120 group by all) join np using (doc_id) where n / n_pages > 0.30),
bo as (select *, string_split(t, chr(10)) as ls from bd where not band and t <> '' and (doc_id, key) not in (select (doc_id, key) from rn)),
ok as (select *, regexp_matches(t, '{_KW}') or not (len(regexp_replace(t, '[^0-9]', '', 'g')) / len(t) > 0.35 and len(ls) <= 6 or len(ls) >= 2 and len(list_filter(ls, lambda x: len({short}) >= 60)) = 0 and not regexp_matches(regexp_replace(ls[1], '{ws}+$', ''), '[.!?:]$')) as fine from bo),
un as (select doc_id, {_CLEAN.format('t')} as text, {_HEADING} as is_marker, page_no, y0, x0, block_no from ok where fine),
us as (select *, len(text) + case when is_marker then 4 else 0 end as size, row_number() over (partition by doc_id order by page_no, y0, x0, block_no) as u from un where text <> ''),
""" + _UNITS.split("from un),\n", 1)[1].format(marker="")
    clean = f"""pp as (select doc_id, lang, source, (case doc_id % 3 when 0 then 'rep' when 1 then 'AR' else 'x' end) || lpad(cast(doc_id % 100 as varchar), 2, '0') || '_' || doc_id || '.pdf' as document,
  array_to_string(list_filter(regexp_extract_all(lower(regexp_replace({_ASCII}, 'https?://\\S+|www\\.\\S+', '', 'g')), '[a-z0-9]+'), lambda x: regexp_matches(x, '^[a-z]+$') and len(x) > 2 and x not in {_in(STOP)} and x not in {_in(sorted(set(vocab.STOP_WORDS)))}), ' ') as t from documents),
py as (select *, coalesce(nullif(regexp_extract(document, '20\\d{{2}}'), ''), '20' || nullif(regexp_extract(document, '(?i)(?:ar|report)(\\d{{2}})\\b', 1), ''), 'N/A') as year from pp where t <> '')"""
    aliases = {k: T.normal_name(v) for k, v in vocab.COMPANY_ALIASES.items()}
    case = lambda c, table: f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {c} end"
    plus, minus = (f"len(list_filter(t, lambda x: x in {_in(_forms(x))}))" for x in (POSITIVE, NEGATIVE))
    return {
        "keyword_pattern_hits": f"with x as (select o_orderkey, {_list(PHRASES)}[o_orderkey % {len(PHRASES)} + 1] || ' with ' || {_list(PHRASES)}[o_orderkey * 7 % {len(PHRASES)} + 1] || case when o_orderkey % 2 = 0 then chr(10) || chr(10) else ' ' end || {_list(PHRASES)}[o_orderkey * 11 % {len(PHRASES)} + 1] as t from orders), h as (select o_orderkey, regexp_extract_all(t, '{T.keyword_pattern()}') as h from x) select o_orderkey, len(h) as n, array_to_string(list_sort(list_distinct(list_transform(h, lambda x: lower(x)))), ',') as keywords from h",
        "page_units": f"with {blocks} select doc_id, para_idx, md5(text) as text_md5, start_char, end_char, section_idx, section from p",
        "metadata_dimension": f"with x as (select s_suppkey, upper('land ' || (s_suppkey % 3)) as country, 'SOCIETE N ' || (s_suppkey % 7) || ' S A' as company_norm, unnest([2018, 2019]) as year, unnest([{cell(2)}, {cell(3)}]) as doc_type from supplier where s_suppkey % 11 <> 0) select country, company_norm, cast(year as integer) as year, doc_type from x qualify row_number() over (partition by country, company_norm, year order by s_suppkey desc) = 1",
        "company_keys": f"with x as (select c_custkey, upper(trim([' españa', 'Alemania', 'Chile '][c_custkey % 3 + 1])) as c, {name(_list(COMPANIES) + '[c_custkey // 3 % ' + str(len(COMPANIES)) + ' + 1]')} as n from customer) select c_custkey, {case('c', vocab.COUNTRY_ALIASES)} as country_key, {case('n', aliases)} as company_norm from x",
        "preprocessed": f"with {clean} select doc_id, document, lang as country, source as company, year, 'Unknown' as doc_type, md5(t) as clean_md5 from (select * exclude (source, lang), source, lang from py)",
        "corpus_round_trip": f"with {clean} select document, lang as country, source as company, year, 'Unknown' as doc_type, md5(t) as clean_md5 from py",
        "zone_file_round_trip": f"with {_ZONES}, zz as (select doc_id, count(*) as n_zones, md5(string_agg(text, repeat(chr(10), 4) order by start_char)) as text_md5 from z group by doc_id) select doc_id || '.pdf' as file, 'data/pdf/' || lang || '/' || source || '/' || doc_id || '.pdf' as path, 'data/chunks_lexical/' || lang || '/' || source || '/' || doc_id || '.json' as zone_path, n_zones, 'keyword_zone' as zone_source, '' as section, text_md5 from zz join documents using (doc_id)",
        "zone_file_errors": "select page_id, case when page_id % 3 = 0 or page_id % 5 = 0 then '' else url end as relevant_text, case when page_id % 3 = 0 then 'not JSON' when page_id % 5 = 0 then 'no relevant_text' else '' end as reason from pages",
        "result_round_trip": f"with {_INDEX} select doc_id, round(sen, 4) as sen, round(idx, 4) as idx, case when idx > 0 then 'Flagged' else 'Not flagged' end as label from ix join co using (doc_id)",
        "word_lists": "select * from (values " + ", ".join(f"('{k}', '{w}')" for k, ws in {"terms": ["carbon", "solar", "wind"], "lines": WORDS_FILE, "hedges": ["from", "that", "this", "with"]}.items() for w in ws) + ") as v(list, word)",
        "dictionary_terms": f"with w as (select doc_id, unnest({_WORDS.format(f'lower({_ASCII})')}) as word from documents), f as (select word, count(distinct doc_id) as df from w where word not in {_in(sorted(set(vocab.TOPIC_STOP_WORDS)))} group by word) select word, df from f where df >= 5 and df <= 0.85 * (select count(*) from documents)",
        "topic_stability": f"with recursive {_TOK}, ct as (select source, token, count(*) as n from tk group by all), rt as (select cast(regexp_extract(source, '(\\d+)$', 1) as integer) as k, token from ct qualify row_number() over (partition by source order by n desc, token) <= 10), st as (select k % 3 as model, k // 3 as topic_id, list(token) as terms from rt group by k), mo as (select model, list(terms order by topic_id) as t from st group by model), r as (select x.model as a, y.model as b, x.t as x, y.t as y, 1 as i, range(1, len(y.t) + 1) as free, 0.0::double as total from mo x join mo y on x.model < y.model union all select a, b, x, y, i + 1, list_filter(free, lambda j: best is null or j <> -best.p), total + coalesce(best.s, 0) from (select *, list_max(list_transform(free, lambda j: {{'s': len(list_intersect(x[i], y[j])) / len(list_distinct(list_concat(x[i], y[j]))), 'p': -j}})) as best from r where i <= len(x))), f as (select total / len(x) as s from r where i = len(x) + 1) select round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, count(*) as n_pairs from f",
        "topic_keywords": f"with {_TOK}, c as (select lang, token, count(*) as n from tk group by all), r as (select *, row_number() over (partition by lang order by n desc, token) as rank from c) select lang as \"Topic_ID\", string_agg(token || ' (' || cast(round(n / 1000.0, 3)::double as varchar) || ')', ', ' order by rank) as \"Keywords\" from r where rank <= 5 group by lang",
        "topic_distribution": "select vec_id as doc_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as dominant_topic, " + ", ".join(f'embedding[{i + 1}]::double as "Topic_{i}"' for i in range(3)) + " from embeddings",
        "polarity_stemmed": f"with t as (select doc_id, regexp_extract_all(lower({_ASCII}), '[a-z]+') as t from documents), n as (select doc_id, {plus} as p, {minus} as n from t) select doc_id, round((p - n) / (p + n + 1e-6::double), 6) as sen from n",
    }


def oracle_sql() -> dict[str, str]:
    label = lambda c: f"case when {c} > 0 then 'Flagged' else 'Not flagged' end"
    line = "case when l_linenumber % 2 = 0 then 'quantity of the ordered part and its number ' else '' end || l_partkey || ' ' || l_suppkey || case when l_linenumber % 3 = 0 then ' orre' else '' end"
    year = "coalesce(nullif(regexp_extract(name, '20\\d{2}'), ''), '20' || nullif(regexp_extract(name, '(?i)(?:ar|report)(\\d{2})\\b', 1), ''), 'N/A')"
    types = "ty as (select doc_id, cast(2018 as integer) as year, case when quality <> 0 then cast(quality as varchar) end as doc_type from labels union all select doc_id, cast(2019 as integer), case when toxic <> 0 then cast(toxic as varchar) end from labels)"
    out = {
        "clean_text": f"select doc_id, md5({_CLEAN.format('text')}) as clean_md5, len({_CLEAN.format('text')}) as n from documents",
        "paragraph_density": f"with {_COUNTED} select doc_id, para_idx, kw_count, word_count, round(density, 4) as density from h",
        "hot_paragraphs": f"with {_COUNTED} select doc_id, para_idx, kw_count from h where density >= 1.0",
        "keyword_zones": f"with {_ZONES} select doc_id, zone_id, lo, hi, start_char, end_char, md5(text) as text_md5, kw_count, word_count, kw_density from z",
        "zone_sections": "with " + _ZONES.replace(_PARAS, _UNITS.format(marker=_HEADING)).replace("min(para_idx) as lo", "min(para_idx) as lo, arg_min(section, para_idx) as section") + " select doc_id, zone_id, start_char, end_char, md5(section) as section_md5 from z",
        "zone_keywords": f"with {_ZONES} select doc_id, zone_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{_KW}'), lambda x: lower(x)))), ',') as keywords from z",
        "char_offsets": f"with {_PARAS} select doc_id, para_idx, start_char, end_char from p",
        "section_carry": f"with {_UNITS.format(marker=_HEADING)} select doc_id, para_idx, section_idx, md5(section) as section_md5, start_char from p",
        "table_filter": f"with x as (select l_orderkey, {line} as t from lineitem) select l_orderkey, count(*) as n_lines, count(*) filter (not regexp_matches(t, '{_KW}') and len(regexp_replace(t, '[^0-9]', '', 'g')) / len(t) > 0.35) as n_tables from x group by l_orderkey",
        "running_lines": f"with {_RUN} select source, key from rn",
        "anti_join_running": f"with {_RUN} select source, count(*) as n from lr where key <> '' and (source, key) not in (select (source, key) from rn) group by source",
        "relevant_text": f"with {_ZONES} select doc_id, count(*) as n_zones, md5(string_agg(text, repeat(chr(10), 4) order by start_char)) as text_md5 from z group by doc_id",
        "year_from_name": f"with x as (select o_orderkey, case when o_orderkey % 4 = 0 then 'rep' || (2000 + o_orderkey % 40) || '.pdf' when o_orderkey % 4 = 1 then 'AR' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || '.pdf' when o_orderkey % 4 = 2 then 'x1' || (o_orderkey % 1000) || '0345' else 'foo' || (o_orderkey % 7) end as name from orders) select o_orderkey, name, {year} as year, try_cast({year} as integer) as year_number from x",
        "path_parts": "select page_id, list_extract(s, -1) as document, list_extract(s, -2) as company, list_extract(s, -3) as country from (select page_id, string_split(url, '/') as s from pages)",
        "doc_type_unpivot": f"with {types} select * from ty",
        "doc_type_lookup": f"with {types} select d.doc_id, coalesce(ty.doc_type, 'Unknown') as doc_type from documents d left join ty on ty.doc_id = d.doc_id and ty.year = 2018 + d.doc_id % 2",
        "alias_lookup": "select n_nationkey, case upper(trim(n_name)) " + " ".join(f"when '{k}' then '{v}'" for k, v in ALIASES.items()) + " else upper(trim(n_name)) end as name from nation",
        "name_normalize": "select s_suppkey, trim(regexp_replace(regexp_replace(strip_accents(upper(trim(s_name))), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) as name from supplier",
        "keyword_large_vocabulary": f"with s as (select unnest({_list(SYLLABLES)}) as s), v as (select x.s || y.s || z.s as t from s x, s y, (select s from s union all select '') z), w as (select doc_id, lower(unnest(regexp_extract_all({_ASCII}, '\\w+'))) as w from documents), h as (select doc_id, w from w where w in (select t from v) or (w like '%s' and left(w, -1) in (select t from v))), c as (select doc_id, count(*) as n, count(distinct w) as n_distinct, md5(string_agg(distinct w, ',' order by w)) as keywords_md5 from h group by doc_id) select doc_id, coalesce(n, 0) as n, coalesce(n_distinct, 0) as n_distinct, coalesce(keywords_md5, md5('')) as keywords_md5 from documents left join c using (doc_id)",
        "lemma_suffix_rules": f"with {_TOK}, p as (select token, {LEMMA} as true_lemma, {UNSEEN} as held_out from (select distinct token from tk where len(token) > 2)), c as (select *, len(list_filter(range(1, least(len(token), len(true_lemma)) + 1), lambda i: left(token, i) = left(true_lemma, i))) as c from p where not held_out), e as (select right(token, cast(k as bigint)) as suffix, len(token) - c as strip, substr(true_lemma, c + 1) as app from c, range(0, 7) r(k) where k <= len(token) and len(token) - c <= k), g as (select suffix, strip, app, count(*) as n from e group by suffix, strip, app), b as (select * from g qualify row_number() over (partition by suffix order by n desc, strip, app) = 1), m as (select token, left(token, len(token) - strip) || app as lemma from p, range(0, 7) r(k), b where held_out and k <= len(token) and suffix = right(token, cast(k as bigint)) and n >= 2 qualify row_number() over (partition by token order by k desc) = 1) select token, held_out, true_lemma, case when held_out then coalesce(nullif(m.lemma, ''), token) else true_lemma end as lemma from p left join m using (token)",
        "token_filter": f"with {_TOK} select doc_id, count(*) as n, count(distinct token) as n_distinct from tk where len(token) > 2 and token not in {_in(HEDGES + NEGATIVE + POSITIVE)} group by doc_id",
        "quant_density": f"with {_COMPONENTS} select doc_id, round(quant, 6) as quant from co",
        "hedge_density": f"with {_COMPONENTS} select doc_id, round(hedge, 6) as hedge from co",
        "tfidf_breadth": f"with {_COMPONENTS} select doc_id, round(sus, 6) as sus from co",
        "polarity": f"with {_COMPONENTS} select doc_id, round(sen, 6) as sen from co",
        "zscore": f"select c_custkey, round({_Z('c_acctbal')}, 6) as z from customer",
        "composite_index": f"with {_INDEX} select doc_id, round(idx, 4) as idx, {label('idx')} as label from ix",
        "composite_index_ext": f"with {_INDEX} select doc_id, round(idx_ext, 4) as idx_ext, {label('idx_ext')} as label_ext from ix",
        "flag_summary": f"with {_INDEX} select count(*) as n_docs, count(*) filter (round(idx, 4) > 0) as n_flagged, count(*) filter (round(idx_ext, 4) > 0) as n_flagged_ext from ix",
        "doc_frequency": f"with {_TOK}, f as (select token, count(distinct doc_id) as df from tk group by token) select token, df from f where df >= 5 and df <= 0.85 * (select count(*) from documents)",
        "bag_of_words": f"with {_TOK} select doc_id, token, count(*) as n from tk group by all",
        "topk_terms": f"with {_TOK}, c as (select lang, token, count(*) as n from tk group by all), r as (select *, row_number() over (partition by lang order by n desc, token) as rank from c) select * from r where rank <= 20",
        "topic_pair_jaccard": f"with {_TOK}, c as (select source, token, count(*) as n from tk group by all), r as (select source, list(token) as t from (select *, row_number() over (partition by source order by n desc, token) as rank from c) where rank <= 10 group by source) select x.source as a, y.source as b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) as jaccard from r x join r y on x.source < y.source",
        "dominant_topic": "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as dominant from embeddings",
        "coherence_umass": f"with {_coherence(None)} select topic_id, round(avg(ln((nij / total + 1e-12::double) / (nj / total))), 6) as u_mass from pr where i > j and nj > 0 group by topic_id",
        "coherence_npmi": f"with {_coherence(10)} select topic_id, round(avg(v), 6) as c_npmi from pm where i <> j group by topic_id",
        "coherence_cv": f"with {_coherence(110)}, ss as (select topic_id, j, sum(v) as s from pm group by all), cs as (select topic_id, i, sum(v * s) / nullif(sqrt(sum(v * v)) * sqrt(sum(s * s)), 0) as c from pm join ss using (topic_id, j) group by all) select topic_id, round(avg(coalesce(c, 0)), 6) as c_v from cs group by topic_id",
    }
    out["zones_of_landing_pages"] = out["keyword_zones"]
    return out | _more_sql() | _variational_sql()
