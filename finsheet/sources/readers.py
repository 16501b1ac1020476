"""Landed tables and files as DataFrames. Nothing here fetches: connectors land files, these read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsheet.functions.coerce import json_sums

PLAN = "plan_name string, plan_type string, is_nil_cost boolean, units_label string, opening_balance double, closing_balance double, granted double, exercised double, lapsed double, weighted_avg_exercise_price double, weighted_avg_grant_date_fair_value double, weighted_avg_remaining_contractual_life_years double, vesting_period_years double, tranches array<struct<grant_date: string, outstanding: double, exercise_price: double>>"
EXTRACTION = f"company string, period string, currency string, plans array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in PLAN.split(', tranches')[0].split(','))}, tranches: array<struct<grant_date: string, outstanding: double, exercise_price: double>>>>"


def tables(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{folder}/{n}.parquet") for n in names)


def delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Registry in a delimited text file with a header, every column a string."""
    return spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False)


def json_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Registry in files that hold one JSON array each."""
    return spark.read.json(path, schema=schema, multiLine=True)


def html_rows(pages: DataFrame, key: list[str], html: str) -> DataFrame:
    """(key, row, cells) of the table rows of a page."""
    rows = pages.select(*key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "inner"))
    cells = F.transform(F.regexp_extract_all(F.col("inner"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " ")))
    return rows.select(*key, "row", cells.alias("cells")).where("size(cells) > 0")


def markdown_rows(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line, cells) of the pipe rows of a text; separators and other lines are dropped."""
    lines = pages.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    table = lines.where(F.startswith(F.col("raw"), F.lit("|"))).where(~F.col("raw").rlike(r"^\|[\s:|\-]+\|?$"))
    inner = F.regexp_replace(F.regexp_replace("raw", r"^\|", ""), r"\|$", "")
    return table.select(*key, "line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def selected_pages(pages: DataFrame, chosen: DataFrame, key: list[str], text: str, cells: str) -> DataFrame:
    """Chosen pages with their table rows (array of arrays) appended, cells joined by `` | ``."""
    joined = F.array_join(F.transform(cells, lambda row: F.array_join(row, " | ", "")), "\n")
    body = F.concat_ws("\n", F.col(text), F.nullif(joined, F.lit("")))
    return pages.join(chosen.select(key).distinct(), key, "left_semi").withColumn(text, body)


def table_cells(strict: Column, lenient: Column) -> Column:
    """Of two detection results the first that holds anything; NULL and empty count as nothing."""
    return F.coalesce(F.when(F.size(strict) > 0, strict), F.when(F.size(lenient) > 0, lenient))


def has_number(cells: Column) -> Column:
    return F.exists(F.flatten(cells), lambda c: F.coalesce(c.rlike(r"\d[\d,\.]+"), F.lit(False)))


def markdown_links(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, anchor, url) of links written ``[anchor](url)``, the first of each address."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(\[[^\]]*\]\(https?://[^)\s]+\))"), F.lit(1))
    every = pages.select(*key, F.posexplode(found).alias("pos", "m")).select(*key, "pos", F.regexp_extract("m", r"^\[([^\]]*)\]", 1).alias("anchor"), F.regexp_extract("m", r"\((.*)\)$", 1).alias("url"))
    first = Window.partitionBy(*key, "url").orderBy("pos")
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def main_member(members: DataFrame, by: list[str], name: str, size: str, preferred: str = "onereport") -> DataFrame:
    """Member of an archive: the one whose name says so, else the largest PDF."""
    pdf = members.where(F.lower(F.col(name)).endswith(".pdf"))
    return pdf.groupBy(*by).agg(F.max_by(name, F.struct(F.contains(F.lower(F.col(name)), F.lit(preferred)), F.col(size), F.col(name))).alias("member"))


def archived_reports(files: DataFrame, path: str) -> DataFrame:
    """(ticker, path) of the newest archived report per ticker, annual before others, names ``<ticker>/FY<year>_<kind>_…``."""
    parts = files.select(path, F.regexp_extract(path, r"([^/]+)/FY(\d{4})_([a-z]+)_[^/]*$", 1).alias("ticker"), F.regexp_extract(path, r"/FY(\d{4})_", 1).try_cast("int").alias("year"), F.regexp_extract(path, r"/FY\d{4}_([a-z]+)_", 1).alias("kind"))
    return parts.where("ticker <> ''").groupBy("ticker").agg(F.max_by(path, F.struct("year", F.col("kind") == "annual", path)).alias("path"))


def loose_json(text: Column) -> Column:
    """JSON object out of an answer: as it is, inside a code fence, the outermost braces, with plain quotes, without trailing commas, with whole numbers for sums; else NULL."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    quoted = F.translate(braces, "\u201c\u201d\u201e\u201f", '""""')
    tidy = F.regexp_replace(quoted, r",(\s*[}\]])", "$1")
    tries = [F.when(t != "", F.try_parse_json(t)) for t in (text, fenced, braces, quoted, tidy, repaired_numbers(tidy), json_sums(repaired_numbers(tidy)))]
    return F.coalesce(*tries).cast("string")


def repaired_numbers(text: Column) -> Column:
    """JSON text whose bare numbers have grouping commas: ``: 1,234`` to ``: 1234``."""
    return F.regexp_replace(text, r"(?<=[:\[]\s{0,4}-?\d{1,3}(?:\d{3}){0,4}),(?=\d{3}(?:\D|$))", "")


def extractions(raw: DataFrame, key: list[str], text: str) -> DataFrame:
    """Extraction records parsed by the plan schema."""
    return raw.select(*key, F.from_json(loose_json(F.col(text)), EXTRACTION).alias("x")).select(*key, "x.*")
