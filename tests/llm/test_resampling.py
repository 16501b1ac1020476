"""Importance resampling against the formulas, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from finsheet.llm import resampling
from finsheet.llm.resampling import resample


def brute(docs, target, longest=1, buckets=10_000, percent=10):
    def words(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in words(t)[1])
    t = Counter(bucket(f) for x in target for f in words(x)[1])
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        w, f = words(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return rows


def key(row):
    return [(v is None, v or 0) for v in row]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50)])
def test_against_the_formulas(spark, docs, corpus, longest, percent, monkeypatch):
    target = [corpus[3][1], "alpha1 beta2 Gamma3", None, "x" * 60]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [list(r) for r in resample(docs, bench, longest=longest, percent=percent).collect()]
    assert sorted(got, key=key) == sorted(brute([(r[0], r[1]) for r in corpus], target, longest, percent=percent), key=key)


def test_small_blocks_give_the_same(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 500)
    bench = spark.createDataFrame([(1, corpus[3][1])], "item_id long, text string")
    got = [list(r) for r in resample(docs, bench).collect()]
    assert sorted(got, key=key) == sorted(brute([(r[0], r[1]) for r in corpus], [corpus[3][1]]), key=key)


def test_repeated_rows_and_no_ids(spark):
    rows = [(1, "w " * 30), (1, "w " * 30), (None, "w " * 30), (None, None), (2, "É é Ω " * 10), (3, "")] + [(9, "a b c d e " * 5)] * 20
    bench = spark.createDataFrame([(1, "w a")], "item_id long, text string")
    got = [list(r) for r in resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, ["w a"]), key=key)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(empty, none).count() == 0
    assert resample(docs, none).count() == docs.count()
