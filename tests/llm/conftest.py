"""Small corpora with every awkward case."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars, extra) with copies, near copies, nulls, empty, short and very long texts."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(30, 120)) for _ in range(40)]
    texts = [*base, *base[:8]]
    for text in base[:12]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    shared = sentence(rng, 60)
    texts += [f"{sentence(rng, 20)}. {shared}. {sentence(rng, 20)}" for _ in range(6)]
    texts += [None, "", " ", "\n\n", "one", "é ß ñ 世界", sentence(rng, 4), "x" * 49, "x" * 50, "x" * 51, "ab" * 200, "ab" * 150, sentence(rng, 30_000)]
    texts += ["\n".join([sentence(rng, 9), "the same line of text in many places 12", sentence(rng, 7)]) for _ in range(5)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["web", "book", None][i % 3], len(t) if t else None, i) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table in several partitions; the extra column has a name that operators use themselves."""
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
