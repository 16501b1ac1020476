"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np

from finsheet.llm.ann_tree import KMeansTree, nearest
from finsheet.llm.llm_queries import op4_nearest_neighbours


def brute(ids, vectors, queries, k=10):
    out = {}
    for q in queries:
        at = ids.index(q)
        d = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        out[q] = [(ids[i], d[i]) for i in sorted((i for i in range(len(ids)) if i != at), key=lambda i: (d[i], ids[i]))[:k]]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_driver_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect(), key=lambda r: r.vec_id)
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    got, want = as_dict(op4_nearest_neighbours(spark, sf)), brute(ids, x, [i for i in ids if i % 100 == 0])
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)


def test_recall_in_many_leaves_and_cells(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1, (400, 16)) for c in rng.normal(0, 2, (10, 16))])
    ids = list(range(len(x)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = as_dict(nearest(table, "vec_id % 40 = 0", sample_rows=1000, cell=64)), brute(ids, x, [i for i in ids if i % 40 == 0])
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert all(s == float(np.sqrt(((x[q] - x[v]) ** 2).sum())) or abs(s - np.sqrt(((x[q] - x[v]) ** 2).sum())) < 1e-12 for q in got for v, s in got[q])


def test_bad_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 7), (1, [0.0, 1.0], 7), (2, [0.0, 1.0], 7), (3, None, 7), (4, [0.0, 0.0], 7), (5, [float("nan"), 1.0], 7), (6, [float("inf"), 1.0], 7), (7, [None, 1.0], 7), (8, [1.0], 7), (100, [2.0, 0.0], 7), (200, None, 7)]
    got = as_dict(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int"), "vec_id % 100 = 0"))
    assert {q: [v for v, _ in got[q]] for q in got} == {0: [100, 1, 2], 100: [0, 1, 2]}


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0").count() == 0


def test_tree_orders_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(900, 4))
    tree = KMeansTree(x, 4, 50)
    assert sorted(tree.order(x[0], 10**6)) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(range(tree.leaves))


def test_rare_scattered_rows_among_dense_ones(spark):
    """Nine tenths in tight groups meet the calibration's mean; the scattered tenth must find its nearest as well."""
    rng = np.random.default_rng(5)
    dense = np.repeat(rng.normal(0, 0.01, (36, 16)), 100, axis=0) + rng.normal(0, 1e-4, (3600, 16))
    x = np.concatenate([dense, rng.normal(0, 10, (400, 16))])[rng.permutation(4000)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = as_dict(nearest(table, "vec_id % 20 = 0", leaf_size=25)), brute(list(range(4000)), x, list(range(0, 4000, 20)))
    assert {q: [v for v, _ in got[q]] for q in got} == {q: [v for v, _ in want[q]] for q in want}


def test_rows_far_from_zero_and_beyond_squares(spark):
    rng = np.random.default_rng(6)
    x = 1e8 + rng.normal(0, 1, (1500, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = as_dict(nearest(table, "vec_id % 30 = 0", leaf_size=25)), brute(list(range(1500)), x, list(range(0, 1500, 30)))
    assert {q: [v for v, _ in got[q]] for q in got} == {q: [v for v, _ in want[q]] for q in want}
    huge = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [2.0, 0.0]), (3, [-1e200, 0.0])], "vec_id long, embedding array<double>")
    assert as_dict(nearest(huge, "vec_id % 100 = 0")) == {0: [(2, 1.0), (1, float("inf")), (3, float("inf"))]}
