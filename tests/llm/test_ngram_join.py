"""Jaccard classes against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from finsheet.llm import ngram_join
from finsheet.llm.ngram_join import keep_one_per_class, ngram_classes, prefix_length


def shingle_set(text):
    words = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, threshold=0.8):
    """(class, links) of each document: components over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}
    links = dict.fromkeys(ids, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (root(i), links[i]) for i in ids}


def as_dict(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_agrees_with_all_pairs(docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    assert as_dict(ngram_classes(docs)) == brute(rows)


def test_agrees_on_driver_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_dict(ngram_classes(docs)) == brute(rows)


def test_large_group_of_near_copies_in_many_blocks(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:59], f"x{i}"])) for i in range(120)] + [(1000 + i, " ".join(words[:30])) for i in range(50)]
    got = as_dict(ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=16))
    assert got == brute(rows)


def test_one_document_of_each_class_stays_whole(docs, corpus):
    kept = keep_one_per_class(docs).collect()
    want = {i for i, (c, _) in brute([(r[0], r[1]) for r in corpus]).items() if i == c}
    assert {r.doc_id for r in kept} == want
    by_id = {r[0]: r for r in corpus}
    assert all(tuple(r) == by_id[r.doc_id] for r in kept)


def test_empty_table(empty):
    assert ngram_classes(empty).count() == 0


@pytest.mark.parametrize(("recall", "deeper"), [(0.9, 0.999), (0.5, 0.9)])
def test_prefix_shrinks_with_the_recall_asked_for(recall, deeper):
    seen = [(0.8, 1.0), (0.9, 3.0)]
    assert prefix_length(seen, 0.8, recall, edge=0) >= prefix_length(seen, 0.8, deeper, edge=0)


def test_prefix_depends_on_the_similarities_seen():
    assert prefix_length([(0.99, 1.0)], 0.8, 0.999, edge=0) == 8
    assert prefix_length([(0.8, 1.0)], 0.8, 0.999, edge=0) < 7
    assert prefix_length([], 0.8, 0.999) <= prefix_length([(0.99, 1.0)], 0.8, 0.999)


def test_measured_recall_of_pairs_near_the_threshold(spark):
    """Pairs whose similarity is just over the threshold, all of other words, so that each link is found or lost by itself."""
    rng = random.Random(21)
    rows = []
    for i in range(150):
        words = [f"p{i}w{k}" for k in range(200)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(0, 200, 20), rng.randrange(1, 5)):
            words[at] = f"p{i}x{at}"
        rows.append((2 * i + 1, " ".join(words)))
    want = brute(rows)
    links = {i for i, (c, _) in want.items() if i != c}
    got = as_dict(ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    recall = sum(got[i] == want[i] for i in links) / len(links)
    print(f"recall of {len(links)} links: {recall:.4f}")
    assert recall >= 0.99 and all(got[i] == want[i] for i in want if i not in links and want[i][1] == 0)


def test_a_column_name_with_a_dot(spark):
    assert [tuple(r) for r in keep_one_per_class(spark.createDataFrame([(1, "x", 7)], "doc_id long, text string, `a.b` int")).collect()] == [(1, "x", 7)]


@pytest.mark.parametrize("near", [0, 40])
def test_prefix_is_the_same_whatever_pairs_the_documents_hold(spark, monkeypatch, near):
    """Many very similar pairs must not lengthen the prefix at the cost of the few at the threshold."""
    lengths = []
    monkeypatch.setattr(ngram_join, "prefix_length", lambda *a, **k: lengths.append(prefix_length(*a, **k)) or lengths[-1])
    words = [[f"p{i}w{k}" for k in range(200)] for i in range(near)]
    rows = [(2 * i + j, " ".join([*w[:199], f"x{j}"])) for i, w in enumerate(words) for j in (0, 1)] + [(1000, "some other words of its own")]
    got = as_dict(ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert ngram_join.met_in_some_tree(0.8, lengths[0]) >= 0.999
