"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words hashed to WORD_DIMS places (log-damped counts, scaled to unit length)
and one place for the bin of each structure statistic and of the declared length. Pairwise interactions have rank
FACTORS and are summed in linear time: half of (sum v x)^2 - sum (v x)^2 for each factor. The model is fitted on a
bounded sample of labelled rows; every whole text is scored where it is read, without a shuffle.

Defined cases: null and empty texts have structure features only and still get a score; a null or missing n_chars has
a bin of its own; repeated rows are scored alike; extra columns are ignored. Without labels the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.kernel import pieces, string_buffers, words
from finsheet.llm.labelled import labelled_sample, remainder

WORD_DIMS = 1 << 17
BINS = 24
STATS = 13
DIMS = WORD_DIMS + STATS * BINS
FACTORS = 6
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other letter, 1 upper, 2 digit, 3 blank, 4 line end, 5 stop, 6 symbol, 7 beyond ASCII
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[33, 34, 39, 44, 46, 58, 59, 63]] = 5
_CLASS[[*range(35, 39), *range(40, 44), 45, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = 6
_CLASS[128:] = 7


def features(texts: pa.Array, declared: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature index, value, offsets) of each text."""
    n = len(texts)
    hashes, first, *_ = words(texts)
    count = np.diff(first)
    place = (hashes >> np.uint64(40)).astype(np.int64) % WORD_DIMS
    key, times = np.unique(np.repeat(np.arange(n), count) * WORD_DIMS + place, return_counts=True)
    doc, place = key // WORD_DIMS, key % WORD_DIMS
    value = 1 + np.log(times)
    value = value / np.sqrt(np.maximum(np.bincount(doc, value**2, minlength=n), 1e-12))[doc]
    distinct = np.bincount(doc, minlength=n)
    data, offsets = string_buffers(texts)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n) * 8, size)
    kinds = np.bincount(owner + _CLASS[data], minlength=8 * n).reshape(n, 8)
    share = np.sqrt(kinds / np.maximum(size, 1)[:, None])  # square roots spread the small shares
    log_bin = lambda x: np.minimum(np.log2(1 + np.asarray(x, dtype=float)) * 1.25, BINS - 1)
    given = declared.to_pandas().to_numpy(dtype=float, na_value=np.nan) if len(declared) else np.zeros(0)
    stats = np.column_stack([
        *(share[:, j] * (BINS - 1) for j in range(8)), log_bin(count), np.minimum(size / np.maximum(count, 1), BINS - 1),
        distinct / np.maximum(count, 1) * (BINS - 1), log_bin(size / (kinds[:, 4] + 1)), np.where(np.isnan(given), 0, 1 + np.minimum(log_bin(np.maximum(np.nan_to_num(given), 0)), BINS - 2)),
    ]).astype(np.int64)
    index = np.concatenate([place, (WORD_DIMS + np.arange(STATS) * BINS + stats).ravel()])
    value = np.concatenate([value, np.full(n * STATS, 0.5)])
    doc = np.concatenate([doc, np.repeat(np.arange(n), STATS)])
    order = np.argsort(doc, kind="stable")
    return index[order], value[order], np.searchsorted(doc[order], np.arange(n + 1))


class FactorisationMachine:
    def __init__(self, seed: int = 3):
        self.bias, self.w = 0.0, np.zeros(DIMS)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (DIMS, FACTORS))

    def margin(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        linear = np.add.reduceat(self.w[index] * value, offsets[:-1])
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, offsets[:-1], axis=0)
        return self.bias + linear + 0.5 * (s**2 - np.add.reduceat(vx**2, offsets[:-1], axis=0)).sum(axis=1)

    def fit(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, ridge: float = 1e-5, seed: int = 5) -> None:
        """Log loss by AdaGrad over shuffled batches."""
        rng, n = np.random.default_rng(seed), len(y)
        self.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        gw, gv, gb = np.full(DIMS, 1e-6), np.full((DIMS, FACTORS), 1e-6), 1e-6
        size = np.diff(offsets)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                own = size[rows]
                ends = np.cumsum(own)
                pick = np.repeat(offsets[rows] - ends + own, own) + np.arange(ends[-1])
                i, x, start = index[pick], value[pick], np.append(0, ends)
                vx = self.v[i] * x[:, None]
                s = np.add.reduceat(vx, start[:-1], axis=0)
                m = self.bias + np.add.reduceat(self.w[i] * x, start[:-1]) + 0.5 * (s**2 - np.add.reduceat(vx**2, start[:-1], axis=0)).sum(axis=1)
                g = 1 / (1 + np.exp(-m)) - y[rows]
                each = np.repeat(g, own)
                places, inverse = np.unique(i, return_inverse=True)
                dw = np.bincount(inverse, each * x) + ridge * self.w[places]
                pull = (each * x)[:, None] * (np.repeat(s, own, axis=0) - vx)
                dv = np.column_stack([np.bincount(inverse, pull[:, f]) for f in range(FACTORS)]) + ridge * self.v[places]
                gw[places] += dw**2
                gv[places] += dv**2
                gb += g.sum() ** 2
                self.w[places] -= rate * dw / np.sqrt(gw[places])
                self.v[places] -= 0.3 * rate * dv / np.sqrt(gv[places])
                self.bias -= rate * g.sum() / np.sqrt(gb)


def fit_sample(sample: DataFrame) -> FactorisationMachine:
    """Fit on the bounded sample: its features come from the executors, the passes over them are made here."""

    def vectors(batches):
        for batch in pieces(batches):
            index, value, offsets = features(batch.column("text"), batch.column("n_chars"))
            cut = [slice(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([index[c].astype(np.int32).tobytes() for c in cut], pa.binary()), pa.array([value[c].astype(np.float32).tobytes() for c in cut], pa.binary())],
                names=["doc_id", "label", "places", "amounts"],
            )

    rows = sorted(sample.mapInArrow(vectors, "doc_id long, label int, places binary, amounts binary").collect(), key=lambda r: (r.doc_id, r.places))
    model = FactorisationMachine()
    if rows:
        parts = [np.frombuffer(r.places, dtype=np.int32) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        model.fit(np.concatenate(parts).astype(np.int64), np.concatenate([np.frombuffer(r.amounts, dtype=np.float32) for r in rows]).astype(float), offsets, np.array([r.label for r in rows], dtype=float))
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, max_good: int = 4000, max_bad: int = 1500, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (probability of quality 1), predicted.

    Fitted on at most ``max_good`` + ``max_bad`` labelled rows whose remainder is not ``held_out``.
    """
    declared = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", declared.alias("n_chars"))
    sample, counts = labelled_sample(own, labels, "quality", remainder("doc_id", modulus) != held_out, {1: max_good, 0: max_bad})
    model = fit_sample(sample)
    taken = {c: min(counts.get(c, 0), m) for c, m in ((1, max_good), (0, max_bad))}
    shift = 0.0
    if all(taken.values()):  # the sample's share of good rows is not the corpus's
        shift = float(np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x (FACTORS + 1) floats at any size of the input

    def score(batches):
        model = shared.value
        for batch in pieces(batches, most=1_000_000):
            margin = model.margin(*features(batch.column("text"), batch.column("n_chars"))) + shift
            p = 1 / (1 + np.exp(-margin.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return own.withColumn("held_out", remainder("doc_id", modulus) == held_out).mapInArrow(score, SCHEMA)
