"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The index holds a bounded sample of labelled rows, so it is small and goes to every task; all documents are
queries and are scored where they are read, without a shuffle. Postings are grouped in blocks of examples. A
query first adds up each block's largest possible cosine, scores the most promising blocks exactly, and then only
those that could still beat its k-th best; the k found are therefore exactly the k nearest.

A word's weight is its TF-IDF times how much its presence says about the label in the sample: a floor, and the size of its log
odds, faded out where that is less than about SURE standard errors. Every word of a text counts, also those
that no example has, and norms are taken over all of them. The calibration looks at the votes and the mass of the cosines:
little of a text in common with any example is little evidence. The floor (1 is plain TF-IDF) and the number of neighbours are
chosen by cross-validation within the sample, from GRID, by the loss of the calibrated score; the calibration is that of the
votes that the sample's rows get from the other folds. Held-out rows are never looked at.

Defined cases: null and empty texts, and texts that share no word with any example, get the prior's calibrated
score and no evidence. Ties go to the earlier example. Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.llm.kernel import pieces, words
from finsheet.llm.labelled import labelled_sample, remainder

BLOCK = 256
#: Standard errors at which a word's log odds count by half.
SURE = 3.0
#: (floor, neighbours) tried, in order of preference where they lose alike; folds of the cross-validation.
GRID, FOLDS = ((1.0, 15), (0.1, 15), (0.1, 41), (0.03, 15), (0.03, 41)), 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, votes double, nearest array<long>, cosine array<double>"


def term_counts(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, count, offsets) of the distinct words of each text."""
    hashes, first, *_ = words(array)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(d[at], np.arange(len(first)))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1 for every i, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of the examples by term, cut at blocks of BLOCK examples, with the largest weight of each piece."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, counts: np.ndarray, offsets: np.ndarray, k: int = 15, floor: float = 0.1, power: float = 2.0):
        n = len(ids)
        self.ids, self.labels, self.k, self.floor, self.power = ids, labels.astype(float), k, floor, power
        example = np.repeat(np.arange(n), np.diff(offsets))
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        df = np.bincount(term, minlength=len(self.vocabulary))
        self.worth = np.log((n + 1) / (df + 0.5)) * self._relevance(term, example, df)
        self.unknown = np.log((n + 1) / 0.5) * floor
        weight = (1 + np.log(counts)) * self.worth[term]
        norm = np.sqrt(np.bincount(example, weight**2, minlength=n))
        weight = weight / np.maximum(norm, 1e-12)[example]
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order].astype(np.int32), weight[order], term[order]
        block = self.example // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.piece = np.append(np.flatnonzero(new), len(term))
        self.piece_block = block[self.piece[:-1]]
        self.piece_max = np.maximum.reduceat(self.weight, self.piece[:-1]) if len(term) else np.zeros(0)
        self.term_piece = np.searchsorted(term[self.piece[:-1]], np.arange(len(self.vocabulary) + 1))
        self.blocks = -(-n // BLOCK) if n else 0

    def _relevance(self, term: np.ndarray, example: np.ndarray, df: np.ndarray) -> np.ndarray:
        """Weight of each word from its log odds in the two classes, the floor at least, 1 at most."""
        n, positive = len(self.labels), self.labels.sum()
        a = np.bincount(term, self.labels[example], minlength=len(df))
        odds = np.log((a + 0.5) / (positive + 1)) - np.log((df - a + 0.5) / (n - positive + 1))
        sure = (np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (df - a + 0.5)) / SURE) ** 4
        told = np.abs(odds) * sure / (1 + sure)
        return self.floor + (1 - self.floor) * told / max(told.max(initial=0.0), 1e-12)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine to a text, best first; ``without`` is left out."""
        if not len(terms) or not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        if not known.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        every = (1 + np.log(counts)) * np.where(known, self.worth[at], self.unknown)
        at, weight = at[known], every[known] / np.sqrt(np.sum(every**2))
        size = self.term_piece[at + 1] - self.term_piece[at]
        entry = ragged(self.term_piece[at], size)
        if not len(entry):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        weight = np.repeat(weight, size)
        block = self.piece_block[entry]
        bound = np.bincount(block, weight * self.piece_max[entry], minlength=self.blocks)
        score = np.zeros(self.blocks * BLOCK)
        ahead = np.zeros(self.blocks, dtype=bool)
        ahead[np.argsort(-bound, kind="stable")[:4]] = True
        self._add(score, entry, weight, ahead[block])
        if without >= 0:
            score[without] = 0
        floor = np.partition(score, -self.k)[-self.k] if len(score) > self.k else 0.0
        rest = ~ahead & (bound >= floor) & (bound > 0)
        if rest.any():
            self._add(score, entry, weight, rest[block])
            if without >= 0:
                score[without] = 0
        found = np.flatnonzero(score > max(0.0, floor - 1e-12))
        found = found[np.argsort(-score[found], kind="stable")][: self.k]
        return found, score[found]

    def _add(self, score: np.ndarray, entry: np.ndarray, weight: np.ndarray, use: np.ndarray) -> None:
        entry, weight = entry[use], weight[use]
        size = self.piece[entry + 1] - self.piece[entry]
        at = ragged(self.piece[entry], size)
        score += np.bincount(self.example[at], np.repeat(weight, size) * self.weight[at], minlength=len(score))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by a power of its cosine; the examples' own share if there is none."""
        w = cosine**self.power
        return float(np.sum(w * self.labels[found]) / np.sum(w)) if np.sum(w) > 0 else float(self.labels.mean() if len(self.labels) else 0)


def evidence(vote: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """What the calibration looks at: the vote, the mass of the cosines (as a logarithm), and both together."""
    m = np.log(np.maximum(mass, 1e-3)) - np.log(1e-3)
    return np.stack([vote, m, vote * m], axis=-1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weighted logistic fit with a little ridge, by Newton's method with halved steps, so that it also ends where the classes part."""
    x = np.hstack([x, np.ones((len(x), 1))])
    a = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + ridge / 2 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        g = x.T @ (weight * (p - y)) + ridge * a
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(a))
        step, share, here = np.linalg.solve(h, g), 1.0, loss(a)
        while share > 1e-9 and loss(a - share * step) > here:
            share /= 2
        a = a - share * step
        if np.abs(share * step).sum() < 1e-9:
            break
    return a[:-1], float(a[-1])


class Sample:
    """The bounded sample as arrays; examples of a class are next to each other, so that the words of one class fill few blocks."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r.label, r.doc_id))
        self.ids, self.labels = np.array([r.doc_id for r in rows], dtype=np.int64), np.array([r.label for r in rows], dtype=np.int64)
        self.terms = [np.frombuffer(r.terms, dtype=np.uint64) for r in rows]
        self.counts = [np.frombuffer(r.counts, dtype=np.int32) for r in rows]
        self.fold = np.arange(len(rows)) % FOLDS

    def index(self, use: np.ndarray, floor: float, k: int) -> BlockMaxIndex:
        at = np.flatnonzero(use)
        join = lambda parts, kind: np.concatenate([parts[i] for i in at] or [np.zeros(0, dtype=kind)])
        offsets = np.concatenate([[0], np.cumsum([len(self.terms[i]) for i in at])]).astype(np.int64)
        return BlockMaxIndex(self.ids[at], self.labels[at], join(self.terms, np.uint64), join(self.counts, np.int32), offsets, k, floor)

    def out_of_fold(self, fold: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(examples of the fold, their votes, their masses) from an index of the other folds."""
        index, own = self.index(self.fold != fold, floor, k), np.flatnonzero(self.fold == fold)
        votes, masses = np.zeros(len(own)), np.zeros(len(own))
        for j, i in enumerate(own):
            found, cosine = index.nearest(self.terms[i], self.counts[i])
            votes[j], masses[j] = index.vote(found, cosine), cosine.sum() / k
        return own, votes, masses


def fit(examples: DataFrame, counts: dict[int, int]) -> tuple[BlockMaxIndex, tuple[np.ndarray, float]]:
    """Index and calibration from the bounded sample, its floor and neighbours chosen by cross-validation in tasks."""

    def vectors(batches):
        for batch in batches:
            terms, count, offsets = term_counts(batch.column("text"))
            cut = [slice(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([terms[c].tobytes() for c in cut], pa.binary()), pa.array([count[c].astype(np.int32).tobytes() for c in cut], pa.binary())],
                names=["doc_id", "label", "terms", "counts"],
            )

    spark = examples.sparkSession
    sample = Sample(examples.select("doc_id", "label", "text").mapInArrow(lambda it: vectors(pieces(it)), "doc_id long, label int, terms binary, counts binary").collect())
    if not len(sample.ids):
        return sample.index(np.zeros(0, dtype=bool), *GRID[0][:1], GRID[0][1]), (np.zeros(3), -10.0)
    shared = spark.sparkContext.broadcast(sample)  # bounded by the sample

    def trial(batches):
        for batch in batches:
            for n in batch.column("id").to_pylist():
                floor, k = GRID[n // FOLDS]
                own, votes, masses = shared.value.out_of_fold(n % FOLDS, floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n // FOLDS)), pa.array(own), pa.array(votes), pa.array(masses)], names=["choice", "example", "vote", "mass"])

    trials = len(GRID) * FOLDS
    seen = spark.range(0, trials, 1, trials).mapInArrow(trial, "choice long, example long, vote double, mass double").toPandas()  # a row an example and choice
    y = sample.labels
    taken = {c: max(1, int(np.sum(y == c))) for c in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / taken[1], counts.get(0, 0) / taken[0])
    weight = weight / max(1e-9, weight.sum()) * len(y)
    best = None
    for choice, (floor, k) in enumerate(GRID):
        own = seen[seen["choice"] == choice].sort_values("example")
        x = evidence(own["vote"].to_numpy(), own["mass"].to_numpy())
        a, b = logistic(x, y, weight)
        z = x @ a + b
        loss = float(np.sum(weight * (np.logaddexp(0, z) - y * z)))
        if best is None or loss < best[0]:
            best = loss, floor, k, (a, b)
    return sample.index(np.ones(len(y), dtype=bool), best[1], best[2]), best[3]


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 1500, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, votes, nearest (example ids), cosine.

    Labels are learnt from at most ``max_toxic`` + ``max_clean`` rows whose remainder is not ``held_out``.
    """
    spark = docs.sparkSession
    examples, counts = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", remainder("doc_id", modulus) != held_out, {0: max_clean, 1: max_toxic})
    index, (a, b) = fit(examples, counts)
    shared = spark.sparkContext.broadcast(index)  # bounded by the sample

    def score(batches):
        index = shared.value
        for batch in pieces(batches):
            terms, counts, offsets = term_counts(batch.column("text"))
            votes, masses, near, cosines = [], [], [], []
            for i in range(batch.num_rows):
                cut = slice(offsets[i], offsets[i + 1])
                found, cosine = index.nearest(terms[cut], counts[cut])
                votes.append(index.vote(found, cosine))
                masses.append(float(cosine.sum()) / index.k)
                near.append(index.ids[found[:3]].tolist())
                cosines.append(cosine[:3].tolist())
            v = np.array(votes, dtype=float)
            p = 1 / (1 + np.exp(-(evidence(v, np.array(masses, dtype=float)) @ a + b)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(v), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "predicted", "votes", "nearest", "cosine"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", modulus) == held_out).alias("held_out"), "text")
    return own.mapInArrow(score, SCHEMA)


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that are not rejected as toxic, whole and with their columns; null ids are kept."""
    rejected = toxicity_scores(docs, labels, threshold=threshold).where("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
