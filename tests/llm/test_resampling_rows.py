"""What the blocks of resampling hold in a row, and that strings of one hash stay apart."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finsheet.llm import resampling


def test_a_row_is_a_document_or_a_few_features(docs):
    rows = resampling.blocks(docs, "doc_id", 1)
    assert rows.where((F.size("words") > 4096) | (F.col("words").isNotNull() & F.col("at").isNotNull())).isEmpty()
    found = rows.where("words is null").select("doc_id", "n_words").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r.n_words == len("".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in texts[r.doc_id] or "").split()) for r in found)


@pytest.mark.parametrize("longest", [1, 3])
def test_strings_of_one_hash_stay_apart(longest, monkeypatch):
    monkeypatch.setattr(resampling, "span_hash", lambda prefix, start, end: np.zeros(len(start), dtype=np.uint64))
    monkeypatch.setattr(resampling, "ROW_WORDS", 5)
    texts = ["Ab ab ba abc", None, "", "ba", "x_y x!y é1", "xy " * 9, "end", "start " * 2]
    features, documents = resampling.block_rows(7, pa.array(range(8), pa.int64()), pa.array(texts), longest)
    words = [w for r in features.to_pylist() for w in r["words"]]
    totals = [n for r in features.to_pylist() for n in r["totals"]]
    assert [r["first"] for r in features.to_pylist()] == list(range(0, len(words), 5))
    want = []
    for text in texts:
        own = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
        want.append(Counter(" ".join(own[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(own) - n + 1)))
    for r, have in zip(documents.to_pylist(), want, strict=True):
        got = Counter()
        for i, n in zip(r["at"], r["times"], strict=True):
            got[words[i]] += n
        assert got == have and r["n_words"] == sum(n for w, n in have.items() if b" " not in w)
    summed = Counter()
    for w, n in zip(words, totals, strict=True):
        summed[w] += n
    assert summed == sum(want, Counter())
