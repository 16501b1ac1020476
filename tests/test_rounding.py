"""Rounding of doubles against the SQL engine's."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from finsheet.functions.coerce import half_even


def test_half_even_rounds_doubles_as_sql_does(spark):
    rng = random.Random(2)
    values = [258920.5 * 1.05, 0.125, 0.375, -0.125, -2.5, 1e300, 1e308, float("inf")] + [rng.randrange(-(10**8), 10**8) / 100 * 1.05 for _ in range(2000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", half_even(F.col("v"), 2).alias("two"), half_even(F.col("v"), 0).alias("none")).orderBy("i").collect()
    want = duckdb.execute("SELECT round_even(v, 2), round_even(v, 0) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert [(r.two, r.none) for r in rows] == want
