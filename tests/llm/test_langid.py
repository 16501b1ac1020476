"""Language ID against n-gram vectors and cosines kept in dictionaries, one text at a time."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from finsheet.llm.langid import DIMS, Centroids, gram_counts, languages

TEXTS = [
    "The quick brown fox jumps over the lazy dog", "Der schnelle braune Fuchs springt über den faulen Hund", "Le renard brun saute par-dessus le chien paresseux, été!", "El zorro marrón salta sobre el perro", "a", "ab", "  x  ", "", "123 456",
    "ÉTÉ Istanbul ß 世界", "the the the the", "der die das und der die das", "les des les un une", "el la los las", "not known", "Zzz" * 50,
]
LANGS = ["en", "de", "fr", "es", "en", "de", "fr", "es", "en", "fr", "en", "de", "fr", "es", "en", "de"]


def grams(text):
    """Counts of hashed 2- and 3-grams of bytes; everything that is no letter is a blank, and nothing spans two blanks at its start."""
    b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
    out = Counter()
    for n in (2, 3):
        for i in range(len(b) - n + 1):
            if b[i] == b[i + 1] == 32:
                continue
            h = b[i]
            for c in b[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            out[(h * 0xC2B2AE3D27D4EB4F % 2**64) >> 52] += 1
    return out


def test_counts_are_those_of_every_position():
    got = gram_counts(pa.array([*TEXTS, None]))
    for i, text in enumerate([*TEXTS, ""]):
        assert {int(k): int(got[i, k]) for k in np.flatnonzero(got[i])} == dict(grams(text))


def test_nearest_centroid_by_cosine():
    """Every prediction, score and rejection from the model's centroids and its idf, by sums over dictionaries."""
    counts = gram_counts(pa.array(TEXTS))
    model = Centroids(counts, LANGS, clusters=2)
    df = Counter(k for t in TEXTS for k in grams(t))
    idf = [math.log((len(TEXTS) + 1) / (df[k] + 0.5)) + 0.1 for k in range(DIMS)]
    assert np.allclose(model.idf, idf)
    asked = [*TEXTS, "the dog and the fox", "und der hund", "qqqq wwww"]
    lang, score, top = model.predict(gram_counts(pa.array(asked)))
    for i, text in enumerate(asked):
        v = {k: math.sqrt(n) * idf[k] for k, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cosines = [sum(x * c[k] for k, x in v.items()) / norm for c in model.centre]
        best = {k: max(x for x, o in zip(cosines, model.owner, strict=True) if o == k) for k in set(model.owner.tolist())}
        share = 1 / sum(math.exp(25 * (x - max(best.values()))) for x in best.values())
        assert math.isclose(top[i], max(best.values()), abs_tol=1e-9)
        assert best[int(lang[i])] >= max(best.values()) - 1e-12
        assert math.isclose(score[i], min(share, 0.5) if top[i] < model.floor else share, abs_tol=1e-9)


def test_centroids_are_unit_means_of_their_texts():
    counts = gram_counts(pa.array(TEXTS))
    model = Centroids(counts, LANGS, clusters=1)
    x = np.sqrt(counts) * model.idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for k, lang in enumerate(model.langs):
        mean = x[[i for i, v in enumerate(LANGS) if v == lang]].mean(axis=0)
        assert np.allclose(model.centre[model.owner == k][0], mean / np.linalg.norm(mean))


def test_very_long_text_and_repeated_rows(spark):
    rows = [(i, "the dog and the fox of it " * 3, "en") for i in range(20)] + [(i, "der hund und der fuchs ist da " * 3, "de") for i in range(20, 40)] + [(50, "the fox " * 200_000, None), (51, None, "en"), (52, "7 7", "de"), (5, "the dog and the fox of it " * 3, "en")]
    out = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    got = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows) and got[50] == "en" and got[51] == got[52] == "und" and got[25] == "de"
