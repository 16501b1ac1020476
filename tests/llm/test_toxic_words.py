"""Every word is a dimension of the cosine; words that go with the label only by chance weigh little."""

from __future__ import annotations

import math
from collections import namedtuple

import numpy as np
import pyarrow as pa

from finsheet.llm.toxicity import GRID, BlockMaxIndex, Sample, logistic, term_counts


def index_of(seed=6, n=1200, floor=0.03):
    rng = np.random.default_rng(seed)
    labels = np.arange(n) % 3 == 0
    texts = [" ".join([f"w{k}" for k in rng.integers(0, 20_000, 150)] + ["nasty", "vile"] * int(y)) for y in labels]
    order = np.argsort(labels, kind="stable")
    texts, labels = [texts[i] for i in order], labels[order]
    terms, counts, offsets = term_counts(pa.array(texts))
    return texts, BlockMaxIndex(np.arange(n), labels, terms, counts, offsets, floor=floor)


def test_telling_words_weigh_most_and_no_word_is_left_out():
    texts, index = index_of()
    assert len(index.vocabulary) == len({w for t in texts for w in t.split()})
    telling = set(term_counts(pa.array(["nasty vile"]))[0])
    top = np.argsort(-index.worth)[:2]
    assert {index.vocabulary[i] for i in top} == telling
    assert np.sort(index.worth)[-2] > 5 * np.quantile(index.worth, 0.9)


def test_nearest_are_those_of_all_pairs():
    """Against a cosine over dictionaries of all words, those of the query that no example has included."""
    texts, index = index_of(7, 600)
    weigh = lambda text: {w: (1 + math.log(text.split().count(w))) * by_word.get(w, index.unknown) for w in set(text.split())}
    words = sorted({w for t in texts for w in t.split()})
    hashes = {w: term_counts(pa.array([w]))[0][0] for w in words}
    by_hash = dict(zip(index.vocabulary.tolist(), index.worth.tolist(), strict=True))
    by_word = {w: by_hash[int(h)] for w, h in hashes.items()}
    vectors = [weigh(t) for t in texts]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for text in ("nasty w1 w2 w3 new", "w5 w6 w7 w8 unseen", " ".join(texts[3].split()[:40]), "vile nasty vile"):
        q = weigh(text)
        want = sorted((-sum(x * v.get(w, 0) for w, x in q.items()) / norm(q) / norm(v), i) for i, v in enumerate(vectors))[: index.k]
        terms, counts, _ = term_counts(pa.array([text]))
        found, cosine = index.nearest(terms, counts)
        assert np.allclose(cosine, [-s for s, _ in want][: len(cosine)])


def test_one_telling_word_in_a_long_text_is_little_evidence():
    _, index = index_of()
    mass = lambda text: float(np.sum(index.nearest(*term_counts(pa.array([text]))[:2])[1]))
    assert mass("nasty " + " ".join(f"x{k}" for k in range(40_000))) < 0.6 * mass("nasty vile")


def test_logistic_ends_where_the_classes_part():
    x = np.linspace(-1, 1, 50)[:, None]
    a, b = logistic(x, (x[:, 0] > 0).astype(float), np.ones(50))
    assert a[0] > 0 and abs(b) < a[0] and np.isfinite(a).all()


def test_a_fold_is_scored_by_the_others_alone():
    """Labels of a fold turned about change nothing in its own votes."""
    Row = namedtuple("Row", "doc_id label terms counts")  # noqa: N806
    rng = np.random.default_rng(3)
    texts = [" ".join([f"w{k}" for k in rng.integers(0, 300, 30)] + ["vile"] * (i % 2)) for i in range(80)]
    rows = []
    for i, t in enumerate(texts):
        terms, counts, _ = term_counts(pa.array([t]))
        rows.append(Row(i, i % 2, terms.tobytes(), counts.astype(np.int32).tobytes()))
    sample = Sample(rows)
    before = sample.out_of_fold(1, 0.1, 5)
    sample.labels = np.where(sample.fold == 1, 1 - sample.labels, sample.labels)
    after = sample.out_of_fold(1, 0.1, 5)
    assert all((a == b).all() for a, b in zip(before, after, strict=True))
    assert GRID[0][0] == 1.0  # plain TF-IDF is tried and preferred among equals


def test_floor_one_is_plain_tf_idf():
    _, index = index_of(floor=1.0)
    df = np.bincount(np.searchsorted(index.vocabulary, index.vocabulary), minlength=len(index.vocabulary))
    assert len(np.unique(index.worth)) <= len(df) and index._relevance(np.zeros(1, dtype=int), np.zeros(1, dtype=int), np.ones(1, dtype=int)).tolist() == [1.0]
