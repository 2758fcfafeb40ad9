"""Document metadata: long form of a year-per-column sheet, aliases and the document-type lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

#: A dimension of at most so many rows is broadcast.
BROADCAST_ROWS = 1_000_000


def with_normal(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the normal form of a name column, made once for each distinct name."""
    table = df.select(F.col(name).alias("_name")).distinct().withColumn(out, T.normal_names(F.col("_name")))
    return df.join(table, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def sheet_to_long(sheet: DataFrame, country: str, company: str, years: list[str]) -> DataFrame:
    """(country, company, year, doc_type, src_row): one row for each cell of a year column from 2000 to 2100; rows without country or company go."""
    kept = [c for c in years if (y := c.replace(".0", "")).isdigit() and 2000 <= int(y) <= 2100]
    rows = sheet.dropna(subset=[country, company]).withColumn("src_row", F.monotonically_increasing_id())
    rows = rows.select(F.upper(T.strip(F.col(country))).alias("country"), F.col(company).alias("company"), "src_row", *[F.col(f"`{c}`").cast("string").alias(c) for c in kept])
    long = rows.unpivot(["country", "company", "src_row"], [f"`{c}`" for c in kept], "year", "doc_type")
    return long.select("country", "company", T.year_number(F.col("year")).alias("year"), T.cell(F.col("doc_type")).alias("doc_type"), "src_row")


def dimension(long: DataFrame) -> DataFrame:
    """(country, company_norm, year, doc_type) of each key's last row."""
    keyed = with_normal(long, "company", "company_norm")
    last = Window.partitionBy("country", "company_norm", "year").orderBy(F.desc("src_row"))
    return keyed.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("country", "company_norm", "year", "doc_type")


def with_keys(corpus: DataFrame, countries: dict[str, str] = vocab.COUNTRY_ALIASES, companies: dict[str, str] = vocab.COMPANY_ALIASES) -> DataFrame:
    """corpus with country_key and company_norm: aliases of the upper-case country and the normal company name."""
    normal = {k: T.normal_name(v) for k, v in companies.items()}
    out = corpus.withColumn("country_key", T.alias(F.upper(T.strip(F.col("country"))), countries))
    out = with_normal(out, "company", "company_norm")
    return out.withColumn("company_norm", T.alias(F.col("company_norm"), normal))


def with_doc_type(corpus: DataFrame, dim: DataFrame) -> DataFrame:
    """corpus with doc_type by country, company and year; Unknown where there is none or it is null."""
    keyed = with_keys(corpus.drop("doc_type")).withColumn("_year", T.year_number(F.col("year")))
    small = dim.select(F.col("country").alias("country_key"), "company_norm", F.col("year").alias("_year"), "doc_type")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return keyed.join(small, ["country_key", "company_norm", "_year"], "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("Unknown"))).drop("country_key", "company_norm", "_year")
