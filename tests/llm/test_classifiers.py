"""Quality, toxicity and language: held-out accuracy, exactness of the index, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from finsheet.llm.langid import languages
from finsheet.llm.llm_queries import op7_quality, op8_toxicity, op10_language
from finsheet.llm.quality_fm import FactorisationMachine, features, quality_scores
from finsheet.llm.toxicity import BlockMaxIndex, drop_toxic, term_counts, toxicity_scores

SF = "/root/testdata/sf0.01"


def fold(i, modulus):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus


def accuracy(spark, scored, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in scored.collect() if r.held_out and r.doc_id in labels]
    return np.mean([r.predicted == labels[r.doc_id] for r in rows]), rows


def test_quality_on_held_out_rows(spark):
    acc, rows = accuracy(spark, op7_quality(spark, SF), "quality")
    assert acc >= 0.85 and all(fold(r.doc_id, 5) == 0 for r in rows) and all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    acc, rows = accuracy(spark, op8_toxicity(spark, SF), "toxic")
    assert acc >= 0.93 and all(fold(r.doc_id, 4) == 2 for r in rows)


def test_language_on_held_out_rows(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op10_language(spark, SF).collect() if r.held_out and known[r.doc_id] is not None]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows]) >= 0.97


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([(r[0], r[0] % 2, (r[0] // 2) % 2) for r in corpus] + [(None, 1, 1), (99_999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_every_row_gets_a_score(score, docs, labels, corpus, empty):
    rows = score(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in corpus)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert score(empty, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in score(docs, labels.limit(0)).collect())


def test_language_of_awkward_rows(docs, corpus, empty):
    got = {r.doc_id: r for r in languages(docs).collect()}
    for i, text, *_ in corpus:
        none = not any(ch.isalpha() for ch in text or "")
        assert (got[i].lang_pred == "und") == none and got[i].held_out == (fold(i, 5) == 0)
        assert 0 <= got[i].score <= 1 and (not none or got[i].score == 0)
    assert languages(empty).count() == 0
    assert {r.lang_pred for r in languages(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_toxic_documents_go_and_others_stay_whole(spark, sf):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r.doc_id for r in toxicity_scores(docs, labels).where("predicted = 1").collect()}
    kept = drop_toxic(spark, docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.4, 40) if k < 500) for _ in range(300)]
    labels = np.array([int("w7 " in t) for t in texts])
    terms, counts, offsets = term_counts(pa.array(texts))
    index = BlockMaxIndex(np.arange(300), labels, terms, counts, offsets, k=7)
    dense = np.zeros((300, len(index.vocabulary)))
    for i in range(300):
        cut = slice(offsets[i], offsets[i + 1])
        at = np.searchsorted(index.vocabulary, terms[cut])
        ok = (at < len(index.vocabulary)) & (index.vocabulary[np.minimum(at, len(index.vocabulary) - 1)] == terms[cut])
        dense[i, at[ok]] = (1 + np.log(counts[cut][ok])) * index.worth[at[ok]]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    for i in range(0, 300, 17):
        cut = slice(offsets[i], offsets[i + 1])
        found, cosine = index.nearest(terms[cut], counts[cut], without=i)
        full = dense @ dense[i]
        full[i] = 0
        np.testing.assert_allclose(cosine, np.sort(full)[::-1][: len(cosine)], atol=1e-9)


def test_factorisation_identity():
    index, value, offsets = features(pa.array(["one two three two", ""]), pa.array([17.0, None]))
    model = FactorisationMachine()
    model.w = np.random.default_rng(1).normal(size=len(model.w))
    i, x = index[: offsets[1]], value[: offsets[1]]
    pairs = sum(model.v[i[a]] @ model.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
    assert model.margin(index, value, offsets)[0] == pytest.approx(model.bias + model.w[i] @ x + pairs)
