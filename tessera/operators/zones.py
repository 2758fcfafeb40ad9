"""Blocks to paragraphs to keyword zones. One exchange on doc_id serves all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

#: A document's paragraphs are window partitions: each is bounded by its document.
DOC = "doc_id"


def in_order(blocks: DataFrame) -> DataFrame:
    """Text blocks with their reading order: page, then y0 and x0."""
    order = Window.partitionBy(DOC).orderBy("page_no", "y0", "x0", "block_no")
    return blocks.where("btype = 0").withColumn("place", F.row_number().over(order) - 1)


def in_band() -> F.Column:
    return (F.col("y1") < F.col("page_h") * vocab.HEADER_BAND) | (F.col("y0") > F.col("page_h") * vocab.FOOTER_BAND)


def running_blocks(blocks: DataFrame, pages: DataFrame, share: float = vocab.RUNNING_SHARE) -> DataFrame:
    """(doc_id, key) of header and footer texts in more than `share` of a document's pages; pages lists all pages, empty ones too."""
    band = blocks.where("btype = 0").where(in_band()).withColumn("text", T.strip(F.col("text"))).where((F.col("text") != "") & (F.length("text") <= vocab.RUNNING_CHARS))
    seen = band.groupBy(DOC, T.running_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))
    return seen.join(pages.groupBy(DOC).agg(F.count("*").alias("n_pages")), DOC).where(F.col("n") / F.col("n_pages") > share).select(DOC, "key")


def units(blocks: DataFrame, pages: DataFrame, keywords: str | None = None) -> DataFrame:
    """(doc_id, unit_idx, text, is_marker): clean paragraphs and section headings of page blocks, in reading order."""
    keywords = keywords or T.trie_pattern()
    body = in_order(blocks).where(~in_band()).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    body = body.withColumn("key", T.running_key(F.col("text"))).join(running_blocks(blocks, pages), [DOC, "key"], "left_anti").where(~T.is_table(F.col("text"), keywords))
    body = body.withColumn("is_marker", T.is_heading(F.col("text"))).withColumn("text", T.clean_block(F.col("text"))).where("text <> ''")
    return body.select(DOC, (F.row_number().over(Window.partitionBy(DOC).orderBy("place")) - 1).alias("unit_idx"), "text", "is_marker")


def line_units(docs: DataFrame, headings: bool = False) -> DataFrame:
    """units of plain documents: each non-blank line is a paragraph, upper-case ones headings if asked for."""
    raw = docs.select(F.col(DOC), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = T.once(raw, "text", T.clean_block(F.col("raw"))).drop("raw").where("text <> ''")
    marker = T.is_heading(F.col("text")) if headings else F.lit(False)
    return lines.select(DOC, (F.row_number().over(Window.partitionBy(DOC).orderBy("line_no")) - 1).alias("unit_idx"), "text", marker.alias("is_marker"))


def paragraphs(unit: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text, start_char, end_char, section_idx, section): offsets count two characters between units, markers ('§ title §') too."""
    order = Window.partitionBy(DOC).orderBy("unit_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text") + F.when(F.col("is_marker"), 4).otherwise(0)
    out = unit.withColumn("start_char", F.coalesce(F.sum(size + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    out = out.withColumn("section_idx", (F.sum(F.col("is_marker").cast("int")).over(upto) - 1).cast("int"))
    out = out.withColumn("section", F.coalesce(F.last(F.when(F.col("is_marker"), F.col("text")), True).over(upto), F.lit("")))
    out = out.where("not is_marker").withColumn("para_idx", F.row_number().over(order) - 1)
    return out.select(DOC, "para_idx", "text", "start_char", (F.col("start_char") + F.length("text")).cast("long").alias("end_char"), "section_idx", "section")


def counted(paras: DataFrame, keywords: str) -> DataFrame:
    """paragraphs with kw_count, word_count and density."""
    hits = F.struct(T.count(F.col("text"), keywords).alias("kw_count"), F.size(T.words(F.col("text"))).cast("long").alias("word_count"))
    out = T.once(paras, "_n", hits).withColumns({"kw_count": F.col("_n.kw_count"), "word_count": F.col("_n.word_count")}).drop("_n")
    return out.withColumn("density", T.density(F.col("kw_count"), F.col("word_count")))


def zones(paras: DataFrame, keywords: str | None = None, threshold: float = vocab.KW_THRESHOLD, context: int = vocab.CONTEXT, least: int = vocab.LEAST_ZONE) -> DataFrame:
    """Keyword-dense zones: paragraphs of `threshold` hits per 100 words or more, with `context` paragraphs on either side.

    Overlapping and adjacent windows are one zone, that is, a maximal run of kept paragraphs. Counts are of
    the joined text, so a pattern may match over a paragraph's end. Zones under `least` characters go.
    """
    keywords = keywords or T.trie_pattern()
    order = Window.partitionBy(DOC).orderBy("para_idx")
    hot = counted(paras, keywords).withColumn("kept", F.max((F.col("density") >= threshold).cast("int")).over(order.rowsBetween(-context, context)))
    runs = hot.where("kept = 1").withColumn("run", F.col("para_idx") - F.row_number().over(order))
    piece = F.struct("para_idx", "text")
    joined = runs.groupBy(DOC, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "\n\n").alias("text"), F.min("para_idx").alias("lo"), F.max("para_idx").alias("hi"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.min_by("section", "para_idx").alias("section"))
    out = joined.where(F.length("text") >= least).withColumn("zone_id", F.row_number().over(Window.partitionBy(DOC).orderBy("start_char")) - 1)
    out = T.once(out, "hits", T.found(F.col("text"), keywords))
    hits = F.col("hits")
    out = out.withColumn("kw_count", F.size(hits).cast("long")).withColumn("word_count", F.size(T.words(F.col("text"))).cast("long"))
    return out.select(DOC, "zone_id", "lo", "hi", "text", "start_char", "end_char", F.lit("keyword_zone").alias("source"), "section", "kw_count", F.array_sort(F.array_distinct(F.transform(hits, F.lower))).alias("keywords_found"), "word_count", F.round(T.density(F.col("kw_count"), F.col("word_count")), 4).alias("kw_density"))


def relevant_text(zone: DataFrame) -> DataFrame:
    """(doc_id, n_zones, relevant_text): a document's zones in order; documents without zones have no row."""
    held = F.array_sort(F.collect_list(F.struct("start_char", "text")))
    return zone.groupBy(DOC).agg(F.count("*").alias("n_zones"), F.array_join(F.transform(held, lambda x: x["text"]), "\n\n\n\n").alias("relevant_text"))
