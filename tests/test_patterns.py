"""Pattern tables against every pattern run on every text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from finsheet.functions.coerce import once
from finsheet.operators import patterns
from finsheet.operators.patterns import Matcher, required_literals


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"\bpsus?\b", ["psu"]), (r"save\s*as\s*you\s*earn", ["save"]), (r"black[\s\-]*scholes\s*(?:model|formula)?", ["scholes"]), (r"a|bc\.d|[xy]z", ["a", "bc.d", "z"]), (r"[abc]+", None),
        (r"(?:^|\n)\s*\d+[.:)]+\s*share", ["share"]), (r"colou?r", ["colo"]), (r"x{0,2}yy", ["yy"]), (r"(?i)abc", None), (r"abc(?!d)", None), (r"[^]a]bc|d", ["bc", "d"]), (r"ab|", None), (r"株式報酬", ["株式報酬"]),
    ],
)
def test_literals_that_a_match_must_hold(pattern, literals):
    assert required_literals(pattern) == literals


def brute(rows, text):
    out = {}
    for tier, pattern in rows:
        m = re.search(pattern, text.lower() if pattern.isascii() else text)
        if m and m.group():
            out.setdefault(tier, []).append(m.group().strip())
    return out


def table(rng, n):
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 5)))
    shapes = [lambda: word(), lambda: rf"\b{word()}s?\b", lambda: rf"{word()}\s*{word()}", lambda: f"(?:{word()}|{word()})[ -]?{word()}", lambda: f"{word()}|{word()}", lambda: rf"{word()}+\.?", lambda: f"é{word()}", lambda: "[ab]+c"]
    return [(rng.choice(["title", "code", "generic"]), rng.choice(shapes)()) for _ in range(n)]


def test_one_walk_finds_what_every_pattern_finds():
    rng = random.Random(8)
    rows = table(rng, 400)
    found = Matcher(rows)
    for _ in range(60):
        text = "".join(rng.choices("abcdeABé -.\n", k=rng.randrange(0, 200)))
        assert found.hits(text) == (brute(rows, text) if text else {})
    assert found.hits(None) == {}


def test_hits_as_a_column(spark):
    rng = random.Random(9)
    rows = table(rng, 50)
    landed = spark.createDataFrame([(t, i, p) for i, (t, p) in enumerate(rows)], "tier string, pos int, pattern string")
    texts = ["".join(rng.choices("abcde ", k=40)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = once(df, hits=patterns.pattern_hits(F.col("text"), patterns.matcher(landed)))
    tiers = patterns.tiers_of(F.col("hits"), ("title", "code", "generic", "other"))
    for r in got.select("text", *[c.alias(k) for k, c in tiers.items()]).collect():
        want = brute(rows, r.text) if r.text else {}
        assert {k: r[k] for k in ("title", "code", "generic", "other")} == {k: want.get(k, []) for k in ("title", "code", "generic", "other")}


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(patterns, "MOST", 3)
    with pytest.raises(ValueError, match="more than 3"):
        patterns.matcher(spark.range(9).selectExpr("'t' as tier", "id as pos", "'a' as pattern"))
