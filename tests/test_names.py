"""Names matched by similarity, parts and beginnings, against all pairs."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from finsheet.operators import approx, resolve


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_similar_names_agree_with_all_pairs(spark, threshold):
    rng = random.Random(8)
    names = sorted({"tesla", "adyen", "ab", "a", "aaaaaaaa", "abababab"} | {"".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14))).strip() or "b" for _ in range(120)})
    names = sorted({" ".join(n.split()) for n in names})
    queries = sorted({"tezla", "adden", "axb"} | {n[:i] + rng.choice("abcdx") + n[i + rng.randrange(2) :] for n in names for i in [rng.randrange(len(n) + 1)]})
    queries = sorted({" ".join(q.split()) for q in queries})
    got = approx.similar_names(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(n,) for n in names], "n string"), "q", "n", threshold)
    want = {}
    for q in queries:
        best = min((-difflib.SequenceMatcher(None, q, n).ratio(), n) for n in names)
        if -best[0] >= threshold:
            want[q] = best[1]
    assert {r.query: r.name for r in got.collect()} == want


def test_industries_by_similarity(spark):
    raw = ["Advertisng", "Auto Part", "Steel", "REIT - Offices", "Drugs Biotechnolgy", "??", "", None]
    name, method = approx.industry(F.col("raw"))
    got = [(r[0], r[1]) for r in spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", name.alias("n"), method.alias("m")).orderBy("i").select("n", "m").collect()]
    assert got == [("Advertising", "fuzzy"), ("Auto Parts", "fuzzy"), ("Steel", "dict"), ("R.E.I.T.", "dict"), ("Drugs (Biotechnology)", "fuzzy"), (None, "none"), (None, "none"), (None, "none")]


NAMES = ["HP Inc", "3M Co", "GE", "General Electric", "Shape", "X", "3D", "", None]
QUERIES = ["hp", "3M", "ge", "g", "x", "3", "general", "zz", ""]


def tables(spark):
    return spark.createDataFrame([(q,) for q in QUERIES], "q string"), spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "n string, filed int")


def test_short_queries_are_found_in_names(spark):
    got = sorted((r.q, r.n) for r in resolve.contains_join(*tables(spark), "q", "n").collect())
    assert got == sorted((q, n) for q in QUERIES for n in NAMES if q and n and q.upper() in n.upper())


def test_short_queries_begin_names(spark):
    got = {r.q: r.n for r in resolve.prefix_family(*tables(spark), "q", "n", "filed", "q").collect()}
    assert got == {q: min((n for n in NAMES if n and n.upper().startswith(q.upper())), key=lambda n: (len(n), n)) for q in QUERIES if q and any(n and n.upper().startswith(q.upper()) for n in NAMES)}


def test_contained_names_never_pass_through_the_driver(spark):
    """Grams are many times the names; cut by row and sent to every task they took the driver's memory."""
    registry = spark.createDataFrame([(i, f"Alpha {'beta' if i % 2 else 'gamma'}") for i in range(600)] + [(600, None), (601, "")], "id long, p string")
    queries = spark.createDataFrame([("BETA",), ("a",), ("",), (None,), ("delta",)], "query string")
    pairs = resolve.contains_join(queries, registry, "query", "p")
    assert {r["query"]: r["n"] for r in pairs.groupBy("query").agg(F.count("*").alias("n")).collect()} == {"BETA": 300, "a": 600}
    assert pairs.columns == ["query", "id", "p"] and "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
