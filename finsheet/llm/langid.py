"""Language by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed byte 2- and 3-grams (lower case, everything but letters is one blank),
scaled to unit length. Each learnt language has up to ``clusters`` centroids, found by spherical k-means over a
bounded sample; a text takes the language of the centroid of largest cosine. Texts farther from every centroid than
nearly all of the sample are flagged as rejected and their score is cut to at most a half.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with null lang teach nothing;
without any learnt language every text is ``und``; repeated rows are alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.kernel import pieces, string_buffers
from finsheet.llm.labelled import remainder

DIMS = 4096
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean"
_LETTER = np.full(256, 32, dtype=np.uint64)  # everything that is no letter counts as a blank
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Dense counts, texts x DIMS, of the hashed 2- and 3-grams of each text."""
    n = len(texts)
    data, offsets = string_buffers(pc.utf8_lower(texts))
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64) * DIMS, size)
    b = _LETTER[data]
    out = np.zeros(n * DIMS)
    for width in (2, 3):
        if len(b) < width:
            continue
        h = b[: len(b) - width + 1].copy()
        for j in range(1, width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + b[j : len(b) - width + 1 + j]
        h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(52)
        inside = owner[: len(h)] == owner[width - 1 :]
        blank = (b[: len(h)] == 32) & (b[1 : len(h) + 1] == 32)
        key = (owner[: len(h)] + h.astype(np.int64))[inside & ~blank]
        out += np.bincount(key, minlength=n * DIMS)
    return out.reshape(n, DIMS)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    def __init__(self, counts: np.ndarray, langs: list[str], clusters: int = 3, rejected_share: float = 0.002, seed: int = 11):
        df = (counts > 0).sum(axis=0)
        self.idf = np.log((len(counts) + 1) / (df + 0.5)) + 0.1
        x = unit(np.sqrt(counts) * self.idf)
        rng = np.random.default_rng(seed)
        self.langs = sorted(set(langs))
        rows, owner = [], []
        for k, lang in enumerate(self.langs):
            own = x[[i for i, v in enumerate(langs) if v == lang]]
            centre = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
            for _ in range(15):
                nearest = np.argmax(own @ centre.T, axis=1)
                centre = unit(np.stack([own[nearest == c].mean(axis=0) if (nearest == c).any() else centre[c] for c in range(len(centre))]))
            rows.append(centre)
            owner += [k] * len(centre)
        self.centre, self.owner = (np.concatenate(rows) if rows else np.zeros((0, DIMS))), np.array(owner, dtype=int)
        self.floor = float(np.quantile((x @ self.centre.T).max(axis=1), rejected_share)) if rows else 0.0

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, best cosine): the score is the best language's share in a sharp softmax of cosines."""
        cosine = unit(np.sqrt(counts) * self.idf) @ self.centre.T
        best = np.full((len(counts), len(self.langs)), -1.0)
        for k in range(len(self.langs)):
            best[:, k] = cosine[:, self.owner == k].max(axis=1)
        top = best.max(axis=1)
        share = 1 / np.exp(25 * (best - top[:, None])).sum(axis=1)
        return best.argmax(axis=1), np.where(top < self.floor, np.minimum(share, 0.5), share), top


def learn(docs: DataFrame, max_per_lang: int, clusters: int) -> Centroids:
    """Centroids from at most ``max_per_lang`` documents of each language, chosen by a hash of the id."""
    known = docs.where("lang is not null and text is not null and length(text) > 0")
    count = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not count:
        return Centroids(np.zeros((0, DIMS)), [], clusters)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, int(1_000_003 * min(1.0, max_per_lang / n)))]), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_003)) < share)

    def vectors(batches):
        for batch in pieces(batches, most=500_000):
            counts = gram_counts(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([np.sqrt(r).astype(np.float16).tobytes() for r in counts], pa.binary())], names=["doc_id", "lang", "root"])

    rows = sorted(chosen.select("doc_id", "lang", "text").mapInArrow(vectors, "doc_id long, lang string, root binary").collect(), key=lambda r: (r.lang, r.doc_id or 0, r.root))
    counts = np.stack([np.frombuffer(r.root, dtype=np.float16) for r in rows]).astype(float) ** 2 if rows else np.zeros((0, DIMS))
    return Centroids(counts, [r.lang for r in rows], clusters)


def languages(docs: DataFrame, max_per_lang: int = 500, clusters: int = 3, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, cosine of the nearest centroid, rejected."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), (remainder("doc_id", modulus) == held_out).alias("held_out"))
    model = learn(own.where("not held_out"), max_per_lang, clusters)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x DIMS numbers

    def predict(batches):
        model = shared.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in pieces(batches, most=500_000):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, texts = part.num_rows, part.column("text")
                lang, score, top = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
                use = np.flatnonzero(has_letter(texts)) if model.langs else np.zeros(0, dtype=int)
                if len(use):
                    lang[use], score[use], top[use] = model.predict(gram_counts(texts.take(pa.array(use))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(top), pa.array((top < model.floor) & (lang < len(model.langs)))],
                    names=["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"],
                )

    return own.select("doc_id", "held_out", "text").mapInArrow(predict, SCHEMA)
