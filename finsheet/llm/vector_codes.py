"""Vector code compression: product codebooks by Lloyd's rounds, with Yinyang bounds and integer arithmetic.

Each component x becomes the integer floor(1024 x); a vector is cut into equal parts, each part position has a codebook, and
a vector's code is the index of the nearest entry for each part. Codebook entries are clustered into groups. A vector keeps,
for each part, the distance to its own entry and one lower bound a group on the distance to all other entries of the group.
When entries have moved, the own distance grows by its entry's drift and a group's bound shrinks by the largest drift in it.
Only groups whose bound no longer exceeds the own distance are scanned, and only for those vectors; scanned distances are
exact integers, so ties go to the lower index. Bounds are rounded down by more than the error of their arithmetic, so a tie
is always scanned.

The state (integers, code, bounds) is a written table; a round reads it, writes the next one and drops it. Codebooks are
small and bounded (parts x entries); they travel with the task. New entries come from sums a task, added up by Spark.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped, as are those that are not as
long as the vector of smallest id or not a multiple of the parts; repeated rows count each; rows of one id are ordered by
their vectors where they open a codebook, rows without an id come last there; with fewer rows than entries the codebooks are
that much smaller; an entry that nothing is assigned to stays; components of 2^23 or more are computed with unbounded
integers, errors beyond 2^53 are rounded and end at the largest long, components end there too; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.common import drop, materialise

#: Entries to a group, about.
GROUP = 16
#: Below this magnitude sums of squares of a part are exact in doubles.
EXACT = 1 << 23
LONGEST = 2**63 - 1
STATE = "vec_id long, label int, x array<long>, code array<int>, own array<double>, bounds array<float>"


def integers(table: DataFrame, parts: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, x) of the rows that take part."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    own = table.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label_column}`").cast("int").alias("label"), v.alias("v"))
    own = own.where("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("d")).limit(1).collect()
    width = first[0].d if first else 0
    return own.where((F.size("v") == width) & (F.size("v") % parts == 0)).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 1024)).alias("x"))


def exact(x: np.ndarray) -> bool:
    return not x.size or int(np.abs(x).max()) < EXACT


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact: doubles where they hold them, else Python's integers."""
    if exact(x) and exact(c):
        x, c = x.astype(float), c.astype(float)
        return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)
    return ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(axis=2)


def lower(d: np.ndarray) -> np.ndarray:
    """Distances as floats that are certainly not above them."""
    return np.nextafter((np.sqrt(d.astype(float)) * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def grouped(entries: np.ndarray) -> np.ndarray:
    """Group of each entry: a few rounds of k-means over the entries, from evenly spread ones."""
    x = entries.astype(float)
    n = max(1, len(x) // GROUP)
    c = x[np.arange(n) * len(x) // n]
    for _ in range(5):
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(n)])
    return near


class Codebook:
    """The entries of one part position, their groups, and how far the last round moved them."""

    def __init__(self, entries: np.ndarray, group: np.ndarray):
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        self.drift = np.zeros(len(entries))
        self.group_drift = np.zeros(len(self.members))

    def moved(self, entries: np.ndarray) -> Codebook:
        new = Codebook(entries, self.group)
        step = (entries.astype(object) - self.entries.astype(object)) ** 2
        new.drift = np.sqrt(step.sum(axis=1).astype(float)) * (1 + 1e-9)
        new.group_drift = np.array([new.drift[m].max(initial=0) for m in self.members])
        return new

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, squared distance, bounds) by a full scan."""
        d = squared(x, self.entries)
        code = np.argmin(d, axis=1)
        rows = np.arange(len(x))
        best = d[rows, code]
        return code, best, np.stack([self._others(d[:, m], m, code) for m in self.members], axis=1)

    @staticmethod
    def _others(d: np.ndarray, members: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Lower bound of a group's distances, without the row's own entry."""
        if not len(members):
            return np.full(len(d), np.inf, dtype=np.float32)
        return lower(np.where(members[None] == code[:, None], np.inf, d.astype(float)).min(axis=1))

    def again(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, squared distance, bounds) after a move: the own entry's distance anew, then the groups whose bound fails."""
        rows = np.arange(len(x))
        diff = x.astype(object if not (exact(x) and exact(self.entries)) else np.int64) - self.entries[code]
        best = (diff**2).sum(axis=1)
        best = best.astype(float) if best.dtype != object else best
        bounds = np.nextafter((bounds - self.group_drift * (1 + 1e-6)).astype(np.float32), np.float32(-np.inf))
        old, old_best, limit = code, best.copy(), np.sqrt(best.astype(float)) * (1 + 1e-9)
        failed = bounds <= limit[:, None]
        code = code.copy()
        scanned: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g in np.flatnonzero(failed.any(axis=0)):
            own, members = rows[failed[:, g]], self.members[g]
            if not len(members):
                continue
            d = squared(x[own], self.entries[members])
            at = np.argmin(d, axis=1)  # members ascend, so the first is the lower index
            near, entry = d[np.arange(len(own)), at], members[at]
            better = (near < best[own]) | ((near == best[own]) & (entry < code[own]))
            code[own[better]], best[own[better]] = entry[better], near[better]
            scanned.append((g, own, d))
        for g, own, d in scanned:
            bounds[own, g] = self._others(d, self.members[g], code[own])
        left = np.flatnonzero(code != old)  # the entry that was left is another of its group now
        bounds[left, self.group[old[left]]] = np.minimum(bounds[left, self.group[old[left]]], lower(old_best[left]))
        return code, best, bounds


def _columns(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def assigned(rows: DataFrame, books: list[Codebook], full: bool) -> DataFrame:
    """The next state: by a full scan, or from the last state by bounds."""
    parts = len(books)

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _columns(batch, "x")
            width, out = x.shape[1] // parts, []
            code, bounds = (None, None) if full else (_columns(batch, "code"), _columns(batch, "bounds"))
            at = 0
            for p, book in enumerate(books):
                own, groups = x[:, p * width : (p + 1) * width], len(book.members)
                out.append(book.first(own) if full else book.again(own, code[:, p], bounds[:, at : at + groups]))
                at += groups
            codes, best, bounds = (np.concatenate([o[i].reshape(len(x), -1) for o in out], axis=1) for i in range(3))
            best = best if best.dtype != object else np.minimum(best, LONGEST).astype(float)
            arrays = [batch.column("vec_id"), batch.column("label"), batch.column("x"), _lists(codes.astype(np.int32), pa.int32()), _lists(best.astype(float), pa.float64()), _lists(bounds.astype(np.float32), pa.float32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "x", "code", "own", "bounds"])

    return rows.mapInArrow(step, STATE)


def sums(state: DataFrame, parts: int, entries: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to (count, sum of each component), from one row an entry and task; parts x entries rows are collected."""

    def add(batches):
        count = np.zeros(parts * entries, dtype=np.int64)
        total = np.zeros((parts * entries, width), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                slot = _columns(batch, "code").astype(np.int64) + np.arange(parts) * entries
                np.add.at(count, slot.reshape(-1), 1)
                np.add.at(total, slot.reshape(-1), _columns(batch, "x").reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), _lists(total[used], pa.int64())], names=["slot", "n", "total"])

    each = state.select("x", "code").mapInArrow(add, "slot long, n long, total array<long>")
    found = each.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)]).alias("total")).collect()
    return {divmod(int(r.slot), entries): (r.n, [int(v) for v in r.total]) for r in found}


def compress(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code array<int>, error long) of every vector, the final codebooks)."""
    rows = materialise(integers(table, parts, id_column, vector_column, label_column), "integers")
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # as many as entries
    if not seeds:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")), []
    start = np.array([r.x for r in seeds], dtype=np.int64)
    width, n = start.shape[1] // parts, len(start)
    books = [Codebook(own, grouped(own)) for own in (start[:, p * width : (p + 1) * width] for p in range(parts))]
    state = materialise(assigned(rows, books, full=True), "codes")
    drop(rows)
    for _ in range(rounds):
        found = sums(state, parts, n, width)
        moved = []
        for p, book in enumerate(books):
            new = book.entries.copy()
            for (part, entry), (count, total) in found.items():
                if part == p:
                    new[entry] = [v // count for v in total]
            moved.append(book.moved(new))
        books = moved
        last, state = state, materialise(assigned(state, books, full=False), "codes")
        drop(last)
    error = F.aggregate("own", F.lit(0.0), lambda a, b: a + b)
    return state.select("vec_id", "label", "code", F.when(error >= LONGEST, F.lit(LONGEST)).otherwise(error.cast("long")).alias("error")), [b.entries for b in books]


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def vector_codes(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error (errors of its label added up), codebooks_sha256."""
    coded, books = compress(table, parts, entries, rounds)
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    own = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return own.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
