"""Fuzzy lines against all pairs of lines."""

from __future__ import annotations

import hashlib
import random
import re

from finsheet.llm.line_dedup import dedup_lines, line_report


def normal(line):
    return re.sub(r"\s+", " ", line.lower()).strip()


def shingles(line, width=9):
    """Nine characters (UTF-16 units) from every position."""
    form = line.encode("utf-16-be")
    return {form[i : i + 2 * width] for i in range(0, max(1, len(form) - 2 * width + 2), 2)}


def brute(rows, threshold=0.8):
    """Kept lines of each document: of each component of lines the first by (doc_id, position)."""
    lines = [(i, p, normal(x)) for i, t in sorted((r for r in rows if r[1] is not None)) for p, x in enumerate(t.split("\n")) if normal(x)]
    keys = sorted({x for _, _, x in lines})
    sets = {k: shingles(k) for k in keys}
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[root(b)] = root(a)
    first, gone = {}, {}
    for i, p, x in lines:
        if first.setdefault(root(x), (i, p)) != (i, p):
            gone.setdefault(i, set()).add(p)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in rows}


def test_agrees_with_all_pairs_of_lines(docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == brute(rows)


def test_near_lines_form_components(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(60):
        base = [words[(i % 6) * 20 + k] for k in range(18)]
        if i >= 6:
            base[rng.randrange(18)] = f"other{i}"
        rows.append((i, "\n".join(["  " + " ".join(base).upper(), f"unique line number {i} of text {rng.random()}", "", " ".join(base[:3])])))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.97 * len(rows)


def test_columns_stay_and_nothing_else_changes(docs, corpus):
    by_id = {r[0]: r for r in corpus}
    for r in dedup_lines(docs).collect():
        assert tuple(r)[2:] == by_id[r.doc_id][2:]


def test_report_digests(docs, corpus):
    want = brute([(r[0], r[1]) for r in corpus])
    for r in line_report(docs).collect():
        text = want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(empty):
    assert dedup_lines(empty).count() == 0
    assert line_report(empty).count() == 0
