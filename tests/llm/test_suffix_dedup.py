"""Suffix dedup against a dictionary of every string."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from finsheet.llm.suffix_dedup import Suffixes, suffix_dedup


def brute(rows, length):
    """The contract, string by string."""
    first = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for at in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][at : at + length], i)
    out = {}
    for i, text in texts.items():
        gone = np.zeros(len(text) + 1, dtype=bool)
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < i:
                gone[at : at + length] = True
        kept = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        spans = int(np.sum(gone[:-1] & ~np.append(False, gone[:-2]))) if len(text) else 0
        out[i] = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def as_dict(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_agrees_with_every_string(docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    got = as_dict(suffix_dedup(docs))
    assert got == brute(rows, 50)


def test_agrees_on_periodic_and_overlapping_text(spark):
    rng = random.Random(3)
    piece = "".join(rng.choice("ab") for _ in range(300))
    rows = [(i, piece[rng.randrange(100) : 200 + rng.randrange(100)] + "c" * rng.randrange(120) + "ab" * rng.randrange(60)) for i in range(30)]
    assert as_dict(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)


def test_agrees_on_driver_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_dict(suffix_dedup(docs)) == brute(rows, 50)


def test_empty_table_and_all_null(spark, empty):
    assert suffix_dedup(empty).count() == 0
    got = as_dict(suffix_dedup(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")))
    assert got == brute([(1, None), (2, None)], 50)


def test_kept_text_round_trip(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(120))
    rows = suffix_dedup(spark.createDataFrame([(1, text), (2, "<" + text + ">")], "doc_id long, text string"), keep_text=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == {1: text.encode(), 2: b"<>"}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_sort_is_a_sort(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.permutation(2900)[:700]
    order = Suffixes(data, 50).sort(start, np.zeros(len(start), dtype=np.int64))
    keys = [data[s : s + 50].tobytes() for s in start[order]]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(700))


def test_rows_of_one_id_keep_their_own_texts(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh") for _ in range(300))
    long = "".join(rng.choice("abcdefgh") for _ in range(5000)) + shared + "zzz"
    rows = [(1, shared), (7, "q" * 60), (7, long), (7, "q" * 60), (None, shared), (9, "x" + shared)]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect())
    assert got == sorted([(300, 0, 0), (60, 0, 0), (5303, 300, 1), (60, 0, 0), (301, 300, 1)])


def test_a_passage_of_most_documents(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = word(400)
    rows = [(i, word(rng.randrange(30, 200)) + (passage if i % 4 else passage[rng.randrange(200) :]) + word(20)) for i in range(400)]
    assert as_dict(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=20_000)) == brute(rows, 50)
