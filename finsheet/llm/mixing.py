"""Mixing sources to target weights by balanced (cube-method) sampling.

Every source has a weight and a target size, f times the words it has. Each of its documents is taken floor(f) times for certain
and once more with probability pi = f - floor(f). The extra copies are drawn by the cube method: within blocks of a source,
longest document first, the vector of probabilities moves along directions in the null space of the balancing constraints
(words and documents), so both totals stay what they were, until at most two documents of the block and a few that wait are
undecided. The undecided of many blocks form new blocks, and so on, until one block per source is left. It lands: its last two
go to the corner that is nearest in words among those less than one document off, and what that corner is off in words is made up
by exchanging pairs, a taken document for one that is not, so that the number of documents stays less than one off.

A source is cut into blocks of about ``block`` documents by a hash of id and text, so a source with a third of all rows
is many tasks, not one. All choices come from such hashes: reruns agree.

Defined cases: a null text has size 0 and is taken 0 words; null sources form one source, ranked last; a source
without words has target 0; repeated rows are mixed each on its own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsheet.llm.common import materialise

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
ROOM = 3.0
#: Documents of each block, spread over its sizes, that wait for the landing.
RESERVE = 16
#: Most exchanges of a landing.
EXCHANGES = 12


def identity():
    """Tells rows apart by id and text; rows that share both are alike."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), identity().alias("key"))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: source, source_size, n_docs, target.

    Weights repeat over the sources in code-point order, null last. Targets are the water level: sources whose share
    would pass ROOM times their size stop there, and what they leave is shared again by weight. Only running totals
    reach the driver, never the list of sources.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    totals = materialise(totals.sort(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "sources")
    held = {r.part: (r.n, r.low) for r in totals.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low")).collect()}  # one row per task
    shift, before = {}, 0
    for part in sorted(held):
        shift[part], before = before - held[part][1], before + held[part][0]
    if not shift:
        return spark.createDataFrame([], "source string, source_size long, n_docs long, target double")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]), F.col("part"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = totals.select("source", "source_size", "n_docs", F.element_at(weights, (F.pmod(F.col("row") + offset, F.lit(len(cycle))) + 1).cast("int")).alias("w"), (F.lit(ROOM) * F.col("source_size")).alias("room"))
    level, total = None, None
    while True:
        full = F.lit(False) if level is None else F.col("w") * level >= F.col("room")
        r = ranked.agg(F.sum("source_size").alias("t"), F.sum(F.when(full, F.col("room")).otherwise(0.0)).alias("stopped"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        total = float(r.t)
        new = (total - r.stopped) / r.w if r.w else level
        if level is not None and new <= level:
            break
        level = new
    return ranked.select("source", "source_size", "n_docs", F.least("room", F.col("w") * level).alias("target"))


def _flight(pi: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are fractional, keeping sum(pi) and sum(pi * size)."""
    pi = pi.copy()
    eps = 1e-9
    pool: list[int] = []
    for nxt in np.flatnonzero((pi > eps) & (pi < 1 - eps)).tolist():
        pool.append(nxt)
        if len(pool) < 3:
            continue
        a, b, c = pool
        # The null space of the rows (1, 1, 1) and (size) is their cross product.
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u[0] == u[1] == u[2] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, d in zip(pool, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pi[i]) / d), min(down, pi[i] / d)
            elif d < 0:
                up, down = min(up, pi[i] / -d), min(down, (1 - pi[i]) / -d)
        step = up if coin[nxt] * (up + down) < down else -down  # up with probability down / (up + down): a martingale
        for i, d in zip(pool, u, strict=True):
            pi[i] = min(1.0, max(0.0, pi[i] + step * d))
        pool = [i for i in pool if eps < pi[i] < 1 - eps]
    return np.where(pi < eps, 0.0, np.where(pi > 1 - eps, 1.0, pi))


def _fly(frame: pd.DataFrame, wait: int = RESERVE) -> pd.DataFrame:
    """Flight over a block, longest first; ``wait`` of its documents, evenly spread over the sizes, stay undecided."""
    frame = frame.sort_values(["size", "key"], ascending=False, kind="stable", ignore_index=True)
    coin = (frame["key"].to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
    pi, size = frame["pi"].to_numpy(), frame["size"].to_numpy(dtype=float)
    moving = (pi > 0) & (pi < 1)
    undecided = np.flatnonzero(moving)
    moving[undecided[np.unique(np.linspace(0, len(undecided) - 1, min(wait, len(undecided))).astype(int))]] = False
    frame["pi"] = np.where(moving, _flight(np.where(moving, pi, 0.0), size, coin), pi)
    return frame


def _land(frame: pd.DataFrame) -> pd.DataFrame:
    """The last block of a source: a flight of all, the nearest corner of what it leaves, then exchanges of pairs."""
    before, documents = float((frame["pi"] * frame["size"]).sum()), float(frame.loc[frame["open"], "pi"].sum())
    frame = _fly(frame, wait=0)
    pi, size = frame["pi"].to_numpy().copy(), frame["size"].to_numpy(dtype=float)
    mine = np.flatnonzero(frame["open"].to_numpy())
    left = [i for i in mine if 0 < pi[i] < 1]
    held, held_size = pi[left].sum(), (pi[left] * size[left]).sum()
    corners = [np.array([k >> i & 1 for i in range(len(left))], dtype=float) for k in range(1 << len(left))]
    pi[left] = min((c for c in corners if abs(c.sum() - held) < 1), key=lambda c: abs((c * size[left]).sum() - held_size))
    for _ in range(EXCHANGES):
        over, more = float((pi * size).sum()) - before, float(pi[mine].sum()) - documents
        taken, free = mine[pi[mine] == 1], mine[pi[mine] == 0][::-1]  # longest first, shortest first
        if abs(over) < 1:
            break
        changes = []  # (words off after it, documents to take out, documents to take in)
        if len(taken) and len(free):
            at = np.searchsorted(size[free], size[taken] - over)
            near = np.stack([np.clip(at - 1, 0, len(free) - 1), np.clip(at, 0, len(free) - 1)])
            rest = np.abs(over - size[taken] + size[free[near]])
            row, column = np.unravel_index(np.argmin(rest), rest.shape)
            changes.append((rest[row, column], [taken[column]], [free[near[row, column]]]))
        for pool, sign in ((taken, -1), (free, 1)):
            if len(pool) and abs(more + sign) < 1:
                i = pool[np.argmin(np.abs(over + sign * size[pool]))]
                changes.append((abs(over + sign * size[i]), [i] if sign < 0 else [], [i] if sign > 0 else []))
        off, out, into = min(changes, key=lambda c: c[0], default=(np.inf, [], []))
        if off >= abs(over):
            break
        pi[out], pi[into] = 0.0, 1.0
    frame["pi"] = pi
    return frame


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), block: int = 2000) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    return _mixed(docs, cycle, block).drop("key")


def _mixed(docs: DataFrame, cycle: tuple[int, ...], block: int) -> DataFrame:
    sizes = materialise(sized(docs), "sizes")
    targets = source_targets(sizes, cycle)
    n = int(targets.agg(F.max("n_docs")).first()[0] or 0)
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, sizes["source"].eqNullSafe(targets["source"])).select("doc_id", "key", targets["source"], "size", "source_size", "target", "n_docs", f.alias("f"))
    rows = rows.select("*", F.floor("f").cast("long").alias("sure"), (F.col("f") - F.floor("f")).alias("share"))
    wait = rows.withColumn("pi", F.when((F.col("share") > 1e-9) & (F.col("share") < 1 - 1e-9), F.col("share")).otherwise(F.round("share")))
    wait = wait.withColumn("open", (F.col("pi") > 0) & (F.col("pi") < 1)).withColumn("cell", F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n_docs") / block)))
    schema = wait.schema
    done, most = None, n
    while True:
        last = most <= block
        flown = materialise(wait.groupBy("source", "cell").applyInPandas(_land if last else lambda frame: _fly(frame), schema), "flight")
        decided = (F.col("pi") == 0) | (F.col("pi") == 1)
        done = flown.where(decided) if done is None else done.unionByName(flown.where(decided))
        if last:
            break
        most = int(np.ceil(most / block)) * (RESERVE + 2)  # at most so many of each block stay undecided
        wait = flown.where(~decided).withColumn("cell", F.pmod(F.xxhash64("key", F.lit(most)), F.lit(int(np.ceil(most / block)))))
    copies = F.col("sure") + F.col("pi").cast("long")
    return done.select("doc_id", "key", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), block: int = 2000) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with its own columns and ``copy`` from 1 (with ``mix_`` in front as often as such a column is there).

    Rows alike in id and text share what they are taken: one copy more for as many of them as the whole number leaves over.
    """
    taken = _mixed(docs, cycle, block).groupBy("key").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows")).where("__all > 0")
    taken = materialise(taken.select(F.col("key").alias("__key"), F.floor(F.col("__all") / F.col("__rows")).cast("int").alias("__copies"), (F.col("__all") % F.col("__rows")).alias("__more")), "copies")
    own = docs.withColumn("__own", identity())
    even = own.join(taken.where("__more = 0"), F.col("__own") == F.col("__key"))
    uneven = own.join(taken.where("__more > 0"), F.col("__own") == F.col("__key"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__own"))
    uneven = uneven.withColumn("__copies", F.col("__copies") + (nth <= F.col("__more")).cast("int")).where("__copies > 0")
    number = "copy"
    while number in docs.columns:
        number = f"mix_{number}"
    return even.unionByName(uneven).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(number))
