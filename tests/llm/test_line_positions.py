"""Fuzzy lines whose differences lie where no word starts, against all pairs on the shingles of every position."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from finsheet.llm.line_dedup import _anchor, _minima, _texts, dedup_lines, line_report


def shingles(line, width=9):
    line = re.sub(r"\s+", " ", line.lower()).strip()
    form = line.encode("utf-16-be")
    return {form[i : i + 2 * width] for i in range(0, max(1, len(form) - 2 * width + 2), 2)}


def kept(spark, lines):
    return [r.text for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "lines",
    [
        ["https://www.example.org/annual-report-2023.pdf", "https://www.company.com/investors/filings", "https://wiki.example.net/page"],
        ["2024-01-01T00:00:01Z-started-worker", "2024-01-01T17:45:59Z-disk-is-full", "2024-01-02T08:00:00Z-shutdown"],
        ["今天天气很好我们一起去公园散步", "今天天气很好我们一起在家看书学习", "วันนี้อากาศดีมากเราไปเดินเล่น", "วันนี้อากาศดีมากเราอ่านหนังสือ"],
    ],
)
def test_lines_with_one_beginning_stay(spark, lines):
    assert kept(spark, lines) == lines


@pytest.mark.parametrize("alphabet", ["abcdefghij/-.", "今天气很好我们一起去公园散步在家看书", "😀😁😂🤣😃😄😅abc"])
def test_near_copies_without_blanks(spark, alphabet):
    rng = random.Random(3)
    base = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (90, 200, 1000)]
    near = [x[:-3] + "xyz" for x in base]
    assert all(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for a, b in zip(base, near, strict=True))
    assert kept(spark, base + near) == [*base, "", "", ""]


def test_minima_are_those_of_every_position(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab cdé世😀") for _ in range(n)).strip() for n in (1, 3, 8, 9, 10, 63, 64, 65, 71, 72, 73, 128, 136, 137, 400, 5000)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = {r.doc_id: r for r in _texts(docs).select("doc_id", "key").join(_minima(docs, 9), "key").collect()}
    every = spark.createDataFrame([(i, bytearray(s)) for i, x in enumerate(lines) for s in shingles(x)], "i long, s binary").select("i", F.xxhash64("s").alias("h"))
    hashes = {r.i: r.h for r in every.groupBy("i").agg(F.collect_set("h").alias("h")).collect()}
    for i, r in rows.items():
        assert list(r.m) == [min(h ^ _anchor(k) for h in hashes[i]) >> 32 for k in range(len(r.m))]


def gone(spark, texts):
    rows = line_report(spark.createDataFrame(texts, "doc_id long, text string"))
    return rows.agg(F.sum("n_removed")).first()[0]


def test_crowded_buckets_lose_no_link(spark):
    """Twins (similarity 0.95) among lines that all share most of their characters (0.7): every bucket is crowded."""
    rng = random.Random(11)
    common = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = []
    for i in range(300):
        own = "".join(rng.choice("klmnopqrstuv") for _ in range(50))
        texts += [(2 * i, common + own), (2 * i + 1, common + own + rng.choice("wxyz"))]
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert alike(texts[0][1], texts[1][1]) > 0.9 and alike(texts[0][1], texts[2][1]) < 0.75
    assert gone(spark, texts) >= 0.97 * 300


def test_a_large_cluster_is_one_component(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghijkl ") for _ in range(300))
    texts = [(i, base[:k] + "#%05d" % i + base[k:]) for i, k in enumerate(rng.choices(range(300), k=400))]
    assert gone(spark, texts) == 399


def test_rows_of_one_id_are_told_apart(spark):
    texts = [(5, "a line that other documents have as well"), (5, "a line that stands nowhere else but here 42"), (3, "a line that other documents have as well")]
    rows = dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in rows) == [(3, texts[2][1]), (5, ""), (5, texts[1][1])]


def test_a_column_name_with_a_dot(spark):
    rows = dedup_lines(spark.createDataFrame([(1, "x", 7)], "doc_id long, text string, `a.b` int")).collect()
    assert [tuple(r) for r in rows] == [(1, "x", 7)]
