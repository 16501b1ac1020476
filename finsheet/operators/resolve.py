"""Entity resolution: priority cascades of joins against a registry, contains, prefix and token matches.

A registry is a DataFrame of any size; nothing here broadcasts it by force. Cascades are one union of keyed joins
and a grouped minimum, so a query row is shuffled once however many rules there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.maps import country_of_ticker
from finsheet.functions.text import fold, name_tokens, tokens_match

GRAM = 3


def one_per_key(registry: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; rows without a key go."""
    rest = [c for c in registry.columns if c != key]
    best = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def cascade(queries: DataFrame, registry: DataFrame, rules: list[tuple[str, str, str]], query_id: str, order: list[str]) -> DataFrame:
    """First rule that finds something, and its first row in ``order``.

    ``rules`` are (name, query column, registry column), tried in that order by equality. Returns the query id,
    matched_via and the registry's columns; queries that no rule resolves are not returned.
    """
    parts = []
    for i, (name, left, right) in enumerate(rules):
        keyed = queries.where(F.col(left).isNotNull()).select(F.col(query_id), F.col(left).alias("__key"))
        side = registry.withColumn("__key", F.col(right))
        parts.append(keyed.join(side, "__key").select(query_id, F.lit(i).alias("__rule"), F.lit(name).alias("matched_via"), *registry.columns))
    found = reduce(DataFrame.unionByName, parts)
    values = ["matched_via", *registry.columns]
    best = found.groupBy(query_id).agg(F.min_by(F.struct(*values), F.struct("__rule", *order)).alias("__r"))
    return best.select(query_id, *[F.col(f"__r.{c}").alias(c) for c in values])


def _grams(name: Column) -> Column:
    """Distinct runs of 1 to GRAM characters."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (n - 1), F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))
    return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)]))


def contains_join(queries: DataFrame, registry: DataFrame, query: str, name: str) -> DataFrame:
    """Pairs whose registry name contains the query (of at least one character), without a nested loop.

    A name that contains the query contains the query's first gram, or the whole of a shorter query, so the join is by
    equality on that. Each name is cut into grams once, however many rows have it. Spark takes a table of grams to be as
    small as its file, so it would send it through the driver: both joins are told to merge.
    """
    left = queries.where(F.length(query) > 0).withColumn("__gram", F.substring(F.upper(query), 1, GRAM))
    right = registry.select(F.col(name).alias("__name")).distinct().withColumn("__gram", F.explode(_grams(F.upper("__name"))))
    met = left.join(right.hint("merge"), "__gram").where(F.contains(F.upper("__name"), F.upper(F.col(query)))).drop("__gram")
    return met.join(registry.withColumn("__name", F.col(name)).hint("merge"), "__name").drop("__name")


def best_by_name(pairs: DataFrame, query_id: str, name: str, active: Column, tie: list[str]) -> DataFrame:
    """Of each query's matches: active ones first, then the shortest name, then ``tie``."""
    order = Window.partitionBy(query_id).orderBy(F.when(active, 0).otherwise(1), F.length(name), *tie)
    return pairs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def exact_then_shortest(pairs: DataFrame, query_id: str, query: str, name: str, tie: list[str]) -> DataFrame:
    """Candidates in the order exact match, then shortest name, then ``tie``: adds position from 1."""
    exact = F.lower(F.trim(F.col(query))) == F.lower(F.col(name))
    order = Window.partitionBy(query_id).orderBy(F.when(exact, 0).otherwise(1), F.length(name), *tie)
    return pairs.withColumn("position", F.row_number().over(order))


def prefix_family(queries: DataFrame, registry: DataFrame, query: str, name: str, filed: str, query_id: str) -> DataFrame:
    """Names that start with the query: the shortest name's family, and of it the newest filing."""
    left = queries.where(F.length(query) > 0).withColumn("__gram", F.substring(F.upper(query), 1, GRAM))
    starts = F.array_distinct(F.array(*[F.substring(F.upper(name), 1, n) for n in range(1, GRAM + 1)]))
    right = registry.withColumn("__gram", F.explode(starts))
    met = left.join(right, "__gram").where(F.startswith(F.upper(F.col(name)), F.upper(F.col(query)))).drop("__gram")
    order = Window.partitionBy(query_id).orderBy(F.length(name), name, F.desc(filed))
    return met.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def wild(x: Column) -> Column:
    """``_`` for every sign that is no letter, digit or blank, so that an apostrophe and a hyphen are one."""
    return F.regexp_replace(x, r"[^0-9A-Za-z%\s]", "_")


def variants(query: Column) -> Column:
    """Spellings to try in order: as typed, without accents, with ``_`` for any punctuation, without a legal ending, and that with ``_``; repeats go."""
    plain = fold(query)
    bare = F.trim(F.regexp_replace(plain, r"\s+(s\.?a\.?s?|s\.?e\.?|a\.?g\.?|n\.?v\.?|b\.?v\.?|s\.?p\.?a\.?|plc|asa|ab|a/s|oyj|oy|gmbh|kgaa|sca)\.?\s*$", ""))
    short = F.when((F.length(bare) >= 3) & (bare != plain), bare)
    spellings = F.array(query, plain, wild(plain), short, wild(short))
    return F.array_distinct(F.filter(spellings, lambda v: v.isNotNull()))


def first_variant(queries: DataFrame, registry: DataFrame, query: str, name: str, query_id: str, tie: list[str]) -> DataFrame:
    """Each query by its first spelling that equals a registry name, case and accents aside; ``_`` stands for any one sign of punctuation."""
    tried = queries.select(query_id, F.posexplode(variants(F.col(query))).alias("tried", "spelling"))
    keys = F.array_distinct(F.array(fold(name), wild(fold(name))))
    met = tried.withColumn("__key", fold("spelling")).join(registry.withColumn("__key", F.explode(keys)), "__key").drop("__key")
    order = Window.partitionBy(query_id).orderBy("tried", *tie)
    return met.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def names_in_texts(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, stop: tuple[str, ...] = (), shortest: int = 4, distinctive: int = 5) -> DataFrame:
    """(key, name, via): names that texts hold, as one word made of all theirs (``slug``) or by each of their telling words (``words``).

    A name's words have ``shortest`` letters or digits and are not on the stop list; those of ``distinctive`` are telling, or all
    where none is so long. Only words of names are kept of the texts, and a text meets a name by its rarest telling word or its
    slug, so a word that every name has is no key. Names without words match nothing; equal rows are found once.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    own = F.filter(words(name), lambda w: (F.length(w) >= shortest) & ~w.isin(*stop, ""))
    wanted = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), own.alias("w")).distinct().where("size(w) > 0")
    telling = F.filter("w", lambda w: F.length(w) >= distinctive)
    wanted = wanted.select("name", F.array_distinct(F.when(F.size(telling) > 0, telling).otherwise(F.col("w"))).alias("need"), F.array_join("w", "").alias("slug"))
    each = wanted.select("name", F.explode("need").alias("word"))
    vocabulary = each.select("word").unionAll(wanted.select("slug")).distinct()
    held = texts.select(F.col(key).alias("key"), F.explode(F.array_distinct(words(text))).alias("word")).join(vocabulary, "word", "left_semi").distinct()
    seen = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(seen, "word").groupBy("name").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    near = held.join(rarest, "word").select("key", "name")
    counted = near.join(each, "name").join(held, ["key", "word"]).groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.join(wanted.select("name", F.size("need").alias("need")), "name").where("n = need").select("key", "name", F.lit(1).alias("rank"))
    glued = held.join(wanted.select("name", F.col("slug").alias("word")), "word").select("key", "name", F.lit(0).alias("rank"))
    best = whole.unionByName(glued).groupBy("key", "name").agg(F.min("rank").alias("rank"))
    return best.select(F.col("key").alias(key), F.col("name").alias(name), F.when(F.col("rank") == 0, "slug").otherwise("words").alias("via"))


def token_subset_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, shortest: int = 3) -> DataFrame:
    """Pairs of names where one token set contains the other.

    The smaller set lies in the larger, so its smallest token is in both: the join is by equality on that token,
    once with each side as the smaller.
    """
    a = left.withColumn("__a", F.sort_array(name_tokens(left_name, shortest)))
    b = right.withColumn("__b", F.sort_array(name_tokens(right_name, shortest)))
    a, b = a.where("size(__a) > 0"), b.where("size(__b) > 0")
    inside = a.withColumn("__t", F.col("__a")[0]).join(b.withColumn("__t", F.explode("__b")), "__t")
    around = a.withColumn("__t", F.explode("__a")).join(b.withColumn("__t", F.col("__b")[0]), "__t")
    both = inside.unionByName(around).where(tokens_match(F.col("__a"), F.col("__b")))
    return both.drop("__t", "__a", "__b").distinct()


def crosslisted(requests: DataFrame, registry: DataFrame, ticker: str, name: str, country: str, us_ticker: str, us_name: str) -> DataFrame:
    """Redirect a foreign line to its US listing: ``1XYZ`` by ticker alone, ``XYZ`` only if the names agree.

    Adds us_match (the US ticker or NULL); rows of the registry must have one row per ticker.
    """
    side = registry.select(F.col(us_ticker).alias("__us"), F.col(us_name).alias("__us_name"))
    bare = F.when(F.startswith(F.col(ticker), F.lit("1")), F.expr(f"substring({ticker}, 2)")).otherwise(F.col(ticker))
    met = requests.withColumn("__bare", bare).join(side, F.col("__bare") == F.col("__us"), "left")
    named = F.col(name).isNotNull() & F.coalesce(tokens_match(name_tokens(name), name_tokens("__us_name")), F.lit(False))
    redirect = F.col("__us").isNotNull() & (F.col(country) != "United States") & (F.startswith(F.col(ticker), F.lit("1")) | named)
    return met.withColumn("us_match", F.when(redirect, F.col("__us"))).drop("__bare", "__us", "__us_name")


def with_country(df: DataFrame, ticker: str, country: str | None = None) -> DataFrame:
    """Ticker without its exchange prefix, and the country of the prefix (an unknown one keeps the given country)."""
    bare, found = country_of_ticker(F.col(ticker))
    return df.withColumns({"bare_ticker": bare, "country": F.coalesce(found, F.col(country) if country else F.lit(None).cast("string"))})


def suggest_domains(candidates: DataFrame, blocked: DataFrame, score: str, domain: str, floor: float = 75) -> DataFrame:
    """Candidates that score at least ``floor`` and are not on the block list."""
    return candidates.where(F.col(score) >= floor).join(blocked.select(F.col(domain)).distinct(), domain, "left_anti")
