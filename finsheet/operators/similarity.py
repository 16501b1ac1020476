"""Similarity joins of names without a gram or token that all names share as a join key.

Every name's grams are ordered by how rare they are over both tables. Two names that must share ``need`` grams share one of the
``size - need + 1`` rarest of either, so only those are joined by equality; what all names have comes last and is no key.
Candidates are verified one by one, so nothing is lost and nothing unlike gets in.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsheet.functions.coerce import once
from finsheet.functions.text import key_of_name


def numbered(grams: Column) -> Column:
    """Grams as a set that keeps repeats: each with how many equal ones came before it."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def runs(form: Column, n: int) -> Column:
    """Runs of ``n`` characters; none of a shorter form."""
    return F.when(F.length(form) >= n, F.transform(F.sequence(F.lit(1), F.length(form) - (n - 1)), lambda i: F.substr(form, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def rare_first(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (key, grams) with each row's grams rarest first, counted over both; ties by the gram itself."""
    each = [df.select("key", F.explode("grams").alias("g")) for df in (left, right)]
    seen = each[0].select("g").unionAll(each[1].select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    order = lambda df: df.join(seen, "g").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("grams"))
    return order(each[0]), order(each[1])


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that can share as many grams as both need; tables are (key, grams, need)."""
    ordered = rare_first(left, right)
    keys = []
    for df, rows, name in ((left, ordered[0], "a"), (right, ordered[1], "b")):
        kept = rows.join(df.select("key", "need"), "key").select("key", F.slice("grams", 1, F.greatest(F.lit(0), F.size("grams") - F.col("need") + 1)).alias("grams"))
        keys.append(kept.select(F.col("key").alias(name), F.explode("grams").alias("g")))
    return keys[0].join(keys[1], "g").select("a", "b").distinct()


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) over all shuffle partitions: they are small and costly to compare, so too few tasks would get them by size."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")


def least_together(length: Column, threshold: float) -> Column:
    """Least length of two forms together, given one of them and a ratio (2 x common / together) of ``threshold``."""
    return 2 * length / (2 - threshold)


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table per machine word operation."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def set_ratio(a: str, b: str) -> float:
    """0 to 100: how alike two names are as sets of words, the words that only one has compared letter by letter.

    100 where one set holds the other; 0 where one is empty.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    gap = int(bool(both))
    one, two = len(both) + gap + len(left), len(both) + gap + len(right)
    ratios = [200 * (len(both) + gap + common_letters(left, right)) / (one + two)]
    if both:
        ratios += [200 * len(both) / (len(both) + n) for n in (one, two)]
    return max(ratios)


def _set_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _words(names: DataFrame, name: str) -> DataFrame:
    """(name, key, words, n): the key is the words of the name's plain form, each once, sorted."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(key_of_name("name"), " "), lambda w: w != "")))
    own = once(names.select(F.col(name).alias("name")).where("name is not null").distinct(), words=words)
    return own.where("size(words) > 0").select("name", F.array_join("words", " ").alias("key"), "words")


def _alike_by_letters(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Candidates whose forms can agree letter by letter, words in any order.

    With m matched letters in k runs of forms that have l together, between two runs at least one letter is unmatched, so
    k <= l - 2m + 1 and at least (1.5 t - 1) l - 1 neighbours are common. At most two of them touch each blank. Where that
    leaves none, as in short forms and at t up to 2/3, single letters are the grams.
    """
    cut = lambda df, grams: once(df, grams=grams)
    letters = lambda df: cut(df, F.split(F.replace("key", F.lit(" "), F.lit("")), "")).select("key", numbered(F.col("grams")).alias("grams"), F.greatest(F.lit(1), F.ceil(t * least_together(F.length("key"), t) / 2 - 1e-9) - (F.size("words") - 1)).cast("int").alias("need"))
    need = F.ceil((1.5 * t - 1) * least_together(F.length("key"), t) - 1 - 1e-9) - 2 * (F.size("words") - 1)
    pairs = lambda df: cut(df, F.flatten(F.transform("words", lambda w: runs(w, 2)))).select("key", numbered(F.col("grams")).alias("grams"), need.cast("int").alias("need"))
    if 1.5 * t <= 1 + 1e-9:
        return prefix_pairs(letters(left), letters(right))
    long = lambda df: pairs(df).where("need > 0")
    short = lambda df: df.where(need <= 0)
    found = prefix_pairs(long(left), long(right))
    found = found.unionByName(prefix_pairs(letters(short(left)), letters(right)))
    return found.unionByName(prefix_pairs(letters(left), letters(short(right))))


def _alike_by_words(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Candidates whose common words are most of one of them.

    2 common / (common + length) >= t means common >= t length / (2 - t). A word counts its letters and a blank; a name's
    commonest words whose letters together fall short of that are no keys on its side.
    """
    ordered = rare_first(*[df.select("key", F.col("words").alias("grams")) for df in (left, right)])
    weight = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w) + 1)
    least = t * F.length("key") / (2 - t) + 1
    rare = lambda df: df.select("key", F.explode(F.filter("grams", lambda w, i: weight(F.slice("grams", i + 1, F.size("grams"))) >= least - 1e-9)).alias("g"))
    every = lambda df: df.select("key", F.explode("grams").alias("g"))
    met = lambda a, b: a.withColumnRenamed("key", "a").join(b.withColumnRenamed("key", "b"), "g").select("a", "b")
    return met(rare(ordered[0]), every(ordered[1])).unionByName(met(every(ordered[0]), rare(ordered[1])))


def alike_as_sets(queries: DataFrame, names: DataFrame, query: str, name: str, threshold: float) -> DataFrame:
    """All pairs (query, name, ratio) whose set ratio is at least ``threshold`` (50 to 100), names compared by their plain form.

    Names without a word match nothing; equal names count once. Agrees with comparing all pairs.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("threshold is a ratio from 50 to 100")
    left, right, t = _words(queries, query), _words(names, name), threshold / 100
    forms = [df.select("key", "words").distinct() for df in (left, right)]
    candidates = spread(_alike_by_letters(*forms, t).unionByName(_alike_by_words(*forms, t)).distinct())
    # Not deterministic for the optimizer, which else moves the comparison below the pairs' union, distinct and spreading.
    ratio = F.pandas_udf(_set_ratios, "double").asNondeterministic()
    scored = candidates.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= threshold - 1e-9)
    met = scored.join(left.select(F.col("key").alias("a"), F.col("name").alias("query")), "a").join(right.select(F.col("key").alias("b"), "name"), "b")
    return met.select("query", "name", "ratio")


def candidates_by_ratio(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (query, a, name, b) of forms whose ratio of matched blocks can be ``threshold``; tables (query, a) and (name, b).

    With m characters matched in k blocks of forms that have l characters together, the ratio is 2m / l. Between two blocks
    at least one character is unmatched, so k <= l - 2m + 1, and m - k pairs of neighbours are common, at least
    (1.5 threshold - 1) l - 1. If there is none, m <= threshold / (3 threshold - 2): such short forms are joined on single
    characters, and so are all of them at a threshold of up to 2/3. Forms without a character match each other.
    """
    alone = math.floor(threshold / (3 * threshold - 2) + 1e-9) if 3 * threshold > 2 + 1e-9 else None
    a, b = left.select(F.col("a").alias("key")).distinct(), right.select(F.col("b").alias("key")).distinct()
    together = F.length("a") + F.length("b")
    fits = 2 * F.least(F.length("a"), F.length("b")) >= threshold * together - 1e-9
    single = F.ceil(threshold * least_together(F.length("key"), threshold) / 2 - 1e-9)
    double = F.ceil((1.5 * threshold - 1) * least_together(F.length("key"), threshold) - 1 - 1e-9)
    cut = lambda df, n: once(df, grams=runs(F.col("key"), n))
    grams = lambda df, n, need: once(cut(df, n), grams=numbered(F.col("grams")), need=F.greatest(F.lit(1), need).cast("int"))
    of = lambda n, need, x, y: prefix_pairs(grams(x, n, need), grams(y, n, need))
    if alone is None:
        pairs = of(1, single, a, b).where(fits)
    else:
        limit = 2 * alone / threshold + 1e-9
        small = lambda df: df.where(F.length("key") <= limit)
        pairs = of(2, double, a, b).where(fits & (together > limit)).unionByName(of(1, single, small(a), small(b)).where(fits & (together <= limit)))
    pairs = pairs.unionByName(a.where("key = ''").select(F.col("key").alias("a")).join(b.where("key = ''").select(F.col("key").alias("b")), F.col("a") == F.col("b")))
    return spread(pairs.join(left, "a").join(right, "b").select("query", "a", "name", "b"))
