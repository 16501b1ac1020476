"""Vector codes against plain Lloyd rounds in unbounded integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from finsheet.llm import vector_codes as vc


def brute(rows, entries, rounds=4, parts=4):
    """[(vec_id, code, error, label)], digest: every part against every entry, every round."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]

    def near(y, book):
        return min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else entry for e, entry in enumerate(books[p])]
    out = []
    for i, x, label in kept:
        found = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return out, hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def check(spark, rows, entries=256):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "label")
    table = table.selectExpr("vec_id", "embedding", "label", "1 as code", "2 as x").repartition(3)
    got = vc.vector_codes(table, entries=entries).collect()
    want, digest = brute(rows, entries)
    of_label = {}
    for _, _, error, label in want:
        of_label[label] = of_label.get(label, 0) + error
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(((i, c, e, of_label[label]) for i, c, e, label in want), key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}


def vectors(rng, n, d=8, scale=0.3):
    return [[float(v) for v in row] for row in rng.normal(0, scale, (n, d))]


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    check(spark, [(int(i), v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors(rng, 400))], entries=48)


def test_ties_and_copies(spark):
    """A coarse grid: many equal distances, a vector that a third of the rows hold."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) / 1024 for v in rng.integers(0, 3, 8)], 1) for i in range(300)] + [(1000 + i, [0.0] * 8, None) for i in range(150)]
    check(spark, rows, entries=64)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.1] * 8, 1), (5, [0.2] * 8, 1), (5, [0.1] * 8, 1), (None, [0.4] * 8, None), (1, None, 1), (2, [], 1), (3, [nan] + [0.0] * 7, 1), (4, [inf] + [0.0] * 7, 2), (6, [None] + [0.0] * 7, 2), (7, [0.0] * 8, 3), (8, [-1e5] * 8, 3)]
    check(spark, rows)
    short = spark.createDataFrame([*rows, (9, [1.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert 9 not in {r.vec_id for r in vc.vector_codes(short).collect()}


def test_huge_components_do_not_overflow(spark):
    table = spark.createDataFrame([(i, [1e15 * i] * 8, 1) for i in range(5)] + [(9, [3e15] * 8, 1)], "vec_id long, embedding array<double>, label int")
    rows = {r.vec_id: r for r in vc.vector_codes(table, entries=3).collect()}
    assert rows[0].error == 0 and all(r.error >= 0 for r in rows.values())


def test_empty_table(spark):
    assert vc.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_miss(seed):
    """Bounds carried over moves of any size give what full scans give, and skip some of the groups."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, 4))
    x = centres[rng.integers(0, 6, 500)] + rng.integers(-4, 5, (500, 4))
    entries = x[:64].copy()
    book = vc.Codebook(entries, vc.grouped(entries))
    code, best, bounds = book.first(x)
    skipped = 0
    for _ in range(6):
        entries = entries + rng.integers(-1, 2, entries.shape)
        book = book.moved(entries)
        code, best, bounds = book.again(x, code, bounds)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        for g, m in enumerate(book.members):
            others = np.where(m[None] == code[:, None], np.inf, d[:, m]).min(axis=1, initial=np.inf)
            assert (bounds[:, g] <= np.sqrt(others)).all()
            skipped += int((bounds[:, g] > np.sqrt(best)).sum())
    assert skipped
