"""Mixing: water-level targets, totals, limits, repeatability."""

from __future__ import annotations

import re

import numpy as np
import pytest

from finsheet.llm.mixing import _flight, apply_mix, mix_sources


def targets(sizes):
    """Weights 1, 2, 3 by code point, null last; what a stopped source leaves is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped.update({s: 3.0 * sizes[s] for s in over})


def check(docs, rows, tolerance):
    out = mix_sources(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    totals = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    want = targets(totals)
    assert sorted(r.doc_id for r in out) == sorted(size)
    taken = dict.fromkeys(totals, 0)
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], totals[s])
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in totals:
        longest = max(size[i] for i in size if source[i] == s)
        assert abs(taken[s] - want[s]) <= max(tolerance * want[s], 0 if longest < 0.3 * totals[s] else longest / 2), (s, taken[s], want[s])
    return out


def test_awkward_corpus(docs, corpus):
    check(docs, corpus, 0.02)


def test_many_blocks_come_near_their_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.pareto(1.2) * 20 + 1), None, ["a", "b", "c", "d", None][min(4, int(rng.exponential(1)))]) for i in range(6000)]
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows], "doc_id long, text string, source string")
    check(docs, rows, 0.01)


def test_reruns_agree(docs):
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(mix_sources(docs)) == key(mix_sources(docs.repartition(3)))


def test_mixed_corpus_has_the_copies(docs):
    copies = {r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies}
    rows = apply_mix(docs).collect()
    seen = {}
    for r in rows:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == copies and set(docs.columns) <= set(rows[0].asDict())


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    pi, size = rng.random(200), rng.integers(1, 1000, 200).astype(float)
    out = _flight(pi, size, rng.random(200))
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
    assert ((out > 0) & (out < 1)).sum() <= 2


@pytest.mark.parametrize("n", [50, 500, 5000])
def test_documents_and_words_are_both_kept(spark, n):
    """No document bypasses the flight: the totals of both are kept but for the landing, whatever share one document has."""
    rng = np.random.default_rng(n)
    rows = [(i, "w " * int(min(20_000, rng.pareto(1.0) * 30 + 1)), "ab"[i % 3 > 0]) for i in range(n)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=800).collect()
    source = {i: s for i, _, s in rows}
    for s in "ab":
        own = [r for r in out if source[r.doc_id] == s]
        f = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - f * len(own)) < 1 + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(20, 0.004 * own[0].target)
        assert {int(f) <= r.copies <= int(f) + 1 for r in own} == {True}


def test_repeated_rows_and_ids_keep_the_targets(spark):
    """Rows of one id, alike or not, are mixed each on its own, also where the corpus is written."""
    rows = [(7, "w " * 20, "a")] * 90 + [(7, "w " * (5 + i), "a") for i in range(60)] + [(None, "v " * 9, "b")] * 50 + [(i, "u " * 11, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {}
    for r in mix_sources(docs).collect():
        want[(r.doc_id, r.size)] = want.get((r.doc_id, r.size), 0) + r.copies
    got = {}
    for r in apply_mix(docs).collect():
        key = (r.doc_id, len(r.text.split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table_and_no_words(spark, empty):
    assert mix_sources(empty).count() == 0
    rows = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
