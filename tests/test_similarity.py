"""Similarity joins against all pairs, and that no gram of all names is a key."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from finsheet.operators import approx, similarity
from finsheet.operators.similarity import alike_as_sets, set_ratio

WORDS = "bank of america amerika group holding holdings siemens siemns energy ag thai oil public company limited petro petroleum nova b c x".split()


def names(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))) for _ in range(n)] + ["", "&", "A.", "Ab", "Bank  OF America", None, "siemens " + "of " * 30, "zzzz"]


def plain(name):
    import re

    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", name.lower().replace("&", " and "))).strip()


@pytest.mark.parametrize("threshold", [55, 70, 80, 100])
def test_agrees_with_all_pairs(spark, threshold):
    left, right = names(1, 60), names(2, 70)
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = sorted((r.query, r.name, round(r.ratio, 6)) for r in alike_as_sets(frame(left, "q"), frame(right, "n"), "q", "n", threshold).collect())
    want = sorted((a, b, round(set_ratio(plain(a), plain(b)), 6)) for a in {x for x in left if x is not None} for b in {x for x in right if x is not None} if set_ratio(plain(a), plain(b)) >= threshold - 1e-9)
    assert got == want and want


@pytest.mark.parametrize(("a", "b", "ratio"), [("fuzzy was a bear", "fuzzy fuzzy was a bear", 100), ("petro", "petro chemical thailand", 100), ("", "", 0), ("abcd", "abce", 75), ("bank one", "bank two", 200 * 6 / 16)])
def test_worked_ratios(a, b, ratio):
    assert set_ratio(a, b) == pytest.approx(ratio)


def test_what_all_names_share_is_no_key(spark):
    """A thousand names of one family: the family's words come last, and the letters of the words that differ are the keys."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=11))
    rows = [f"{word()} {word()} co ltd" for _ in range(1000)]
    forms = similarity._words(spark.createDataFrame([(x,) for x in rows], "n string"), "n")
    ordered, _ = similarity.rare_first(*[forms.select("key", F.col("words").alias("grams"))] * 2)
    assert {r.g for r in ordered.select(ordered["grams"][0].alias("g")).collect()}.isdisjoint({"co", "ltd"})
    pairs = similarity._alike_by_letters(forms.select("key", "words"), forms.select("key", "words"), 0.9).count()
    assert pairs < 300_000  # of a million


def test_empty_tables(spark):
    none = spark.createDataFrame([], "x string")
    assert alike_as_sets(none, none, "x", "x", 80).count() == 0
    with pytest.raises(ValueError, match="50 to 100"):
        alike_as_sets(none, none, "x", "x", 20)


def test_a_name_is_folded_once_not_once_a_character(spark):
    """What makes the form of a name stands in the plan only below the step that holds the form."""
    names = spark.createDataFrame([("small rod",), ("Small  Rod & Co",), ("smal rod",)], "n string")
    found = approx.similar_names(names, names.select(F.upper("n").alias("m")), "n", "m", 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("lower(") for line in plan.splitlines()) == 1
    assert {(r.query, r.name) for r in found.collect()} == {("small rod", "SMALL ROD"), ("Small  Rod & Co", "SMALL  ROD & CO"), ("smal rod", "SMAL ROD")}


def test_the_bound_before_difflib_changes_no_ratio():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    for a in words:
        for b in words:
            whole = difflib.SequenceMatcher(None, a, b).ratio()
            assert approx._ratio(a, b, 0.8) == (whole if whole >= 0.8 else approx._ratio(a, b, 0.8)) and (whole >= 0.8) == (approx._ratio(a, b, 0.8) >= 0.8)


def test_pairs_are_compared_in_all_partitions(spark):
    """Pairs are small and costly; by their size alone they would all be one task's."""
    frame = spark.createDataFrame([(f"{x} holdings {y}",) for x in "abcdef" for y in "xyzuvw"], "n string")
    found = alike_as_sets(frame, frame, "n", "n", 80)
    assert "RepartitionByExpression [a#" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 36


def test_pairs_are_compared_after_they_are_distinct_and_spread(spark):
    """The comparison stands above the spreading once, not below it in each join that makes pairs."""
    frame = spark.createDataFrame([(f"{x} holdings {y}",) for x in "abcdef" for y in "xyzuvw"], "n string")
    for found in (alike_as_sets(frame, frame, "n", "n", 80), approx.similar_names(frame, frame.select(F.upper("n").alias("m")), "n", "m", 0.8)):
        lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        compared = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
        assert len(compared) == 1 and compared[0] < next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
