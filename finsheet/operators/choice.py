"""Choices between documents, runs and sites, each a grouped minimum over an explicit rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.text import host, registrable


def primary_document(rows: DataFrame, by: list[str], kind: str, year: str, tie: str, newest_interim: bool = False) -> DataFrame:
    """Primary document and runner-up of each key: results, then annual, then interim.

    With ``newest_interim`` an interim document precedes the annual one unless that is of a later year.
    """
    annual_year = F.max(F.when(F.col(kind) == "annual", F.coalesce(F.col(year), F.lit(0)))).over(Window.partitionBy(*by))
    ahead = F.coalesce(F.col(year), F.lit(0)) >= F.coalesce(annual_year, F.lit(0)) if newest_interim else F.lit(False)
    rank = F.when(F.col(kind) == "results", 0).when((F.col(kind) == "interim") & ahead, 1).when(F.col(kind) == "annual", 2).otherwise(3)
    order = Window.partitionBy(*by).orderBy("__rank", F.desc_nulls_last(year), tie)
    placed = rows.withColumn("__rank", rank).withColumn("place", F.row_number().over(order)).where("place <= 2")
    return placed.drop("__rank")


def first_form_with_rows(rows: DataFrame, by: list[str], form: str, forms: list[str]) -> DataFrame:
    """Rows of the first form, in the given order, that has any for the key."""
    rank = F.array_position(F.array(*[F.lit(f) for f in forms]), F.col(form))
    ranked = rows.withColumn("__rank", rank).where("__rank > 0")
    return ranked.withColumn("__best", F.min("__rank").over(Window.partitionBy(*by))).where("__rank = __best").drop("__rank", "__best")


def newest_passing(candidates: DataFrame, by: list[str], year: str, score: str, passes: Column, tie: list[str], probes: int = 8) -> DataFrame:
    """Of the first ``probes`` candidates by year and score the newest that passes the gate."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(year), F.desc(score), *tie)
    probed = candidates.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= probes).where(passes)
    best = Window.partitionBy(*by).orderBy("__n")
    return probed.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__n", "__k")


def site_evidence(rows: DataFrame, by: list[str], url: str, source: str, tier: str) -> DataFrame:
    """Each key's best domain by number of distinct backers, then tier: domain, backers, tier, confidence."""
    domains = rows.withColumn("domain", registrable(url)).groupBy(*by, "domain").agg(F.count_distinct(source).alias("backers"), F.max(tier).alias("tier"), F.max(F.col(source) == "wikidata").alias("authority"))
    best = domains.groupBy(*by).agg(F.max_by(F.struct("domain", "backers", "tier", "authority"), F.struct("backers", "tier", "domain")).alias("b")).select(*by, "b.*")
    return best.withColumn("confidence", confidence(F.col("backers"), F.col("tier"), F.col("authority"))).drop("authority")


def confidence(backers: Column, tier: Column, authority: Column, mismatch: Column | None = None, verified: Column | None = None) -> Column:
    """Band of a resolved site: agreement, authority, tier; a wrong country or a failed check lowers it."""
    band = F.when(backers >= 2, "HIGH").when(authority & (tier == 3), "HIGH").when(tier >= 2, "MEDIUM").otherwise("LOW")
    for bad in (mismatch, None if verified is None else ~verified):
        if bad is not None:
            band = F.when(F.coalesce(bad, F.lit(False)), "LOW").otherwise(band)
    return band


def site_score(url: Column, ticker: Column, tokens: Column) -> Column:
    """Rule terms of an investor site's score (the similarity terms are added by the caller where wanted)."""
    h, label = host(url), F.split_part(registrable(url), F.lit("."), F.lit(1))
    low = F.lower(ticker)
    path = F.regexp_extract(F.lower(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return (
        F.when(low == label, 10).otherwise(0) + F.when(F.contains(h, F.concat(F.lit("invest-"), low)), 8).otherwise(0)
        + F.when(F.exists(tokens, lambda t: F.contains(label, t)), 4).otherwise(0) + F.when(h.rlike(r"^(ir|investors?)\."), 6).otherwise(0)
        + F.when(path.rlike("invest|shareholder|/ir(/|$)"), 5).otherwise(0) + F.when(F.startswith(url, F.lit("https://")), 1).otherwise(0)
        - F.when(h.rlike(r"(archive|legacy|old)\."), 8).otherwise(0) - F.when(path.rlike("/(contact|privacy|terms|careers)"), 6).otherwise(0)
    )


def keep_second_pass(first: Column, second: Column) -> Column:
    """The second extraction unless it has fewer plans."""
    return F.when(F.size(second) >= F.size(first), second).otherwise(first)


def coverage(rows: DataFrame, key: list[str], fields: list[str], known: list[str]) -> DataFrame:
    """Per row: which fields are filled (sorted), which known ones are missing."""
    filled = F.sort_array(F.map_keys(F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda k, v: v.isNotNull())))
    return rows.select(*key, filled.alias("filled"), F.sort_array(F.array_except(F.array(*[F.lit(k) for k in known]), filled)).alias("gaps"))


def context_block(rows: DataFrame, by: list[str], pos: str, title: str, text: str, most: int = 8000) -> DataFrame:
    """Numbered sources of each key as one text, each cut at ``most`` characters."""
    one = F.struct(F.col(pos), F.concat(F.lit("] "), F.col(title), F.lit("\n"), F.substring(text, 1, most)).alias("t"))
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("s"))
    return gathered.select(*by, F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), x["t"])), "\n\n").alias("block"))


def cache_name(ticker: Column, company: Column) -> Column:
    """Key of a result: the ticker without its venue, else the company's name, else NULL."""
    bare = F.upper(F.trim(F.regexp_replace(F.trim(ticker), "^[^:]*:", "")))
    name = F.regexp_replace(F.lower(F.trim(company)), r"\s+", " ")
    return F.coalesce(F.nullif(bare, F.lit("")), F.when(name != "", F.concat(F.lit("name:"), name)))


def region(country: Column, french: tuple[str, ...], australian: tuple[str, ...], european: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(country))
    return F.when(low.isin(*french), "fr").when(low.isin(*australian), "au").when(low.isin(*european), "eu")


def vintage_warnings(year: Column, form: Column, as_of_year: int) -> Column:
    """Warnings about an old filing and about an annual one standing in for a quarterly one."""
    old = F.when(year < as_of_year - 1, F.concat(F.lit("vintage FY"), year.cast("string")))
    annual = F.when(form.rlike("(?i)annual|10-K|20-F|40-F"), F.concat(F.lit("annual filing "), form))
    return F.filter(F.array(old, annual), lambda w: w.isNotNull())
