"""Upserts by bucket: what is untouched stays as it is, and no rerun does harm."""

from __future__ import annotations

from pathlib import Path

import pytest

from finsheet.sources import keyed
from finsheet.sources.keyed import KeyedTable


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(spark, pairs, columns="k string, n int, v string"):
    return spark.createDataFrame(pairs, columns)


def content(table):
    return sorted((r.k, r.n, r.v) for r in table.read().collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["n"], buckets=8)
    assert t.read() is None
    assert len(t.upsert(rows(spark, [(f"k{i}", 1, "old") for i in range(200)]))) == 8
    before = files(tmp_path)
    touched = t.upsert(rows(spark, [("k7", 2, "new"), ("k7", 1, "stale"), ("new", 1, "x")]))
    assert 1 <= len(touched) <= 2
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) - len(before) == len(touched)
    assert content(t) == sorted([(f"k{i}", 1, "old") for i in range(200) if i != 7] + [("k7", 2, "new"), ("new", 1, "x")])


def test_a_batch_that_failed_before_its_manifest_is_not_seen_and_can_run_again(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["n"], buckets=4)
    t.upsert(rows(spark, [("a", 1, "one"), ("b", 1, "one")]), batch=0)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", fail)
        with pytest.raises(RuntimeError, match="lost"):
            t.upsert(rows(spark, [("a", 2, "two")]), batch=1)
    assert content(t) == [("a", 1, "one"), ("b", 1, "one")]
    t.upsert(rows(spark, [("a", 2, "two")]), batch=1)
    assert content(t) == [("a", 2, "two"), ("b", 1, "one")]


def test_a_batch_that_is_in_is_skipped_and_old_versions_go(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["n"], buckets=1)
    for i in range(6):
        t.upsert(rows(spark, [("a", i, str(i))]), batch=i)
    assert t.upsert(rows(spark, [("a", 99, "again")]), batch=5) == []
    assert content(t) == [("a", 5, "5")]
    assert len(list(Path(tmp_path / "t" / f"{keyed.BUCKET}=0").iterdir())) == 2
    assert t.upsert(rows(spark, []), batch=6) == [] and t.state()["batch"] == 6


def test_columns_may_be_added_and_keys_may_be_null(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["n"], buckets=4)
    t.upsert(rows(spark, [("a", 1, "x"), (None, 1, "y")]))
    t.upsert(rows(spark, [(None, 2, "z", 5)], "k string, n int, v string, w int"))
    assert {(r.k, r.v, r.w) for r in t.read().collect()} == {("a", "x", None), (None, "z", 5)}


def test_two_writers_of_one_batch(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["n"], buckets=2)
    t.upsert(rows(spark, [("a", 1, "x")]), batch=3)
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(3, {})
