"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and holds centres only; every vector is then dealt to its leaf. A leaf of many
vectors is cut into cells and the queries that visit it into parts, so one task has at most about ``cell`` vectors and
``cell`` queries. A query walks the tree with a priority queue of
squared distances to centres and so gets the leaves in best-bin-first order; how many it visits is widened, on a
bounded set of calibration queries answered by brute force, until their recall reaches the target. A mean recall says
nothing of the single query, so each then visits whatever other leaf lies no farther than its k-th find (distance to
the centre less the radius of the leaf's rows), which leaves no nearer vector out. Distances are exact Euclidean
distances in double precision.

Defined cases: vectors that are null, of another length than most, all zero, or hold null or non-finite components
take no part; a query has all candidates if there are fewer than k; ties go to the smaller id; repeated vectors are
all candidates; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsheet.llm.common import materialise

RESULT = "query_id long, vec_id long, score double"


class KMeansTree:
    """Centres only: children[i] lists a node's children, leaves have a number."""

    def __init__(self, sample: np.ndarray, branching: int, leaf_size: int, seed: int = 1):
        self.centre: list[np.ndarray] = [sample.mean(axis=0) if len(sample) else np.zeros(0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            groups = self._split(own, branching, rng) if len(own) > leaf_size else []
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for centre, members in groups:
                self.children[node].append(len(self.centre))
                todo.append((len(self.centre), members))
                self.centre.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.centre = np.stack(self.centre)
        self.leaf_centre = np.stack([c for _, c in sorted((n, tuple(c)) for n, c in zip(self.leaf, self.centre, strict=True) if n >= 0)])

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        middle = x.mean(axis=0)  # squares of rows far from zero would drown their differences
        x = x - middle
        c = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
        for _ in range(12):
            near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
            c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        return [(c[j] + middle, x[near == j] + middle) for j in range(len(c)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[kids] - self.centre[node]
            near = np.argmin((c**2).sum(axis=1) - 2 * (x[rows] - self.centre[node]) @ c.T, axis=1)
            todo += [(kid, rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                d = ((self.centre[kids] - q) ** 2).sum(axis=1)
                best = int(np.argmin(d))
                for j, kid in enumerate(kids):
                    if j != best:
                        heapq.heappush(queue, (float(d[j]), kid))
                node = kids[best]
            out.append(self.leaf[node])
        return out

    def off_centre(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Distance of each vector to the centre of its leaf."""
        return np.sqrt(((x - self.leaf_centre[leaf]) ** 2).sum(axis=1))

    def within(self, q: np.ndarray, reach: float, radius: np.ndarray) -> np.ndarray:
        """Leaves that can hold a vector no farther than ``reach``, given the radius of each leaf's rows."""
        d = np.sqrt(((self.leaf_centre - q) ** 2).sum(axis=1))
        return np.flatnonzero(~(d - radius > reach + 1e-9 * (d + radius)))


def best_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k nearest of ``vectors`` but itself, ties to the smaller id, by exact differences."""
    found = []
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    for q, own in zip(queries, query_ids, strict=True):
        others = np.flatnonzero(ids != own)
        d = ((vectors - q) ** 2).sum(axis=1)[others]  # infinite where squares overflow, a candidate all the same
        near = np.argsort(d, kind="stable")[:k] if len(d) <= 4 * k else _smallest(d, k)
        found.append(pd.DataFrame({"query_id": own, "vec_id": ids[others[near]], "score": np.sqrt(d[near])}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    edge = np.partition(d, k - 1)[k - 1]
    near = np.flatnonzero(d <= edge)
    return near[np.argsort(d[near], kind="stable")][:k]


def clean_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(vector_column).cast("array<double>")
    own = table.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    own = own.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))").where("exists(v, x -> x <> 0)")
    width = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return own.where(F.size("v") == (width[0].d if width else 0))


def nearest(table: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", sample_rows: int = 20_000, branching: int = 8, leaf_size: int = 100, calibration_queries: int = 48, recall: float = 0.97, cell: int = 4096) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score. ``is_query`` is a condition on ``vec_id``.

    ``sample_rows`` bounds the rows the tree is fitted on, ``calibration_queries`` those answered by brute force.
    """
    spark = table.sparkSession
    vectors = materialise(clean_vectors(table, id_column, vector_column), "vectors")
    n = vectors.count()
    pick = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_003))
    sample = vectors.where(pick < int(1_000_003 * min(1.0, sample_rows / max(1, n)))).select("v").toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = KMeansTree(np.unique(np.stack(sample.to_numpy()), axis=0), branching, leaf_size)
    shared = spark.sparkContext.broadcast(tree)  # at most sample_rows / leaf_size x branching centres

    def stack(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)

    def deal(batches):
        for b in batches:
            if b.num_rows:
                x = stack(b.column("v"))
                leaf = shared.value.assign(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf), pa.array(shared.value.off_centre(x, leaf))], names=["vec_id", "v", "leaf", "off"])

    dealt = materialise(vectors.mapInArrow(deal, "vec_id long, v array<double>, leaf long, off double"), "dealt")
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / cell).alias("cells"), F.max("off").alias("radius")).collect()  # one row per leaf of the bounded tree
    cells, radius = {r.leaf: int(r.cells) for r in sizes}, np.zeros(tree.leaves)
    for r in sizes:
        radius[r.leaf] = r.radius
    literal = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    cells_of = F.element_at(literal(cells), F.col("leaf"))
    dealt = dealt.select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id", F.lit(9)), cells_of).alias("cell"))

    def search(queries: DataFrame, visits: int, candidates: DataFrame) -> DataFrame:
        """``queries`` against the leaves they visit; each cell answers with its own k best.

        With a column ``reach`` they visit the leaves within it that are not among their first ``visits``.
        """
        further = "reach" in queries.columns
        keys = [F.col(c).cast("long").alias(c) for c in ("leaf", "cell", "part")]  # a cogroup meets keys of one type only: an int hashes unlike a long

        def walk(batches):
            """Which leaves each query visits; the vectors are added by Spark, once a visit."""
            for b in batches:
                q = stack(b.column("v")) if b.num_rows else []
                leaves = [shared.value.order(x, visits) for x in q]
                if further:
                    reach = b.column("reach").to_numpy(zero_copy_only=False)
                    leaves = [np.setdiff1d(shared.value.within(x, r, radius), own).tolist() for x, r, own in zip(q, reach, leaves, strict=True)]
                leaves = [[x for x in own if x in cells] for own in leaves]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaves, pa.list_(pa.int64()))], names=["query_id", "q", "leaves"])

        def answer(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return best_k(np.stack(q["q"].to_numpy()), q["query_id"].to_numpy(), np.stack(v["v"].to_numpy()), v["vec_id"].to_numpy(), k)

        walked = materialise(queries.mapInArrow(walk, "query_id long, q array<double>, leaves array<long>"), "walked")
        visiting = walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # one row per leaf of the bounded tree
        parts = F.coalesce(F.try_element_at(literal({r.leaf: -(-int(r["count"]) // cell) for r in visiting} or {-1: 1}), F.col("leaf")), F.lit(1))
        asked = walked.select("query_id", "q", F.explode("leaves").alias("leaf")).withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(21)), parts))
        asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), cells_of - 1))).select("query_id", "q", *keys)
        vectors_of = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("vec_id", "v", *keys)
        found = asked.groupBy("leaf", "cell", "part").cogroup(vectors_of.groupBy("leaf", "cell", "part")).applyInPandas(answer, RESULT)
        return _top(found, k)

    queries = vectors.where(is_query)
    share = int(1_000_003 * min(1.0, calibration_queries / max(1, queries.count())))
    trial = materialise(queries.where(F.pmod(F.xxhash64("vec_id", F.lit(77)), F.lit(1_000_003)) < share), "calibration")
    asked = trial.collect()  # about calibration_queries rows at any size

    def brute(batches):
        q = np.stack([np.array(r.v) for r in asked])
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pandas(best_k(q, np.array([r.vec_id for r in asked]), stack(b.column("v")), b.column("vec_id").to_numpy(), k).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

    visits = tree.leaves
    if asked:
        truth = materialise(_top(vectors.mapInArrow(brute, RESULT), k), "truth")
        wanted, visits = truth.count(), max(2, tree.leaves // 32)
        while visits < tree.leaves:
            got = search(trial, visits, dealt).join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
            if got >= recall * wanted:
                break
            visits = min(tree.leaves, visits * 2)
    found = search(queries, visits, dealt)
    if visits < tree.leaves:
        found = materialise(found, "first")
        reach = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
        rest = queries.join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        found = _top(found.drop("rank").unionByName(search(rest, visits, dealt).drop("rank")), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; rows beyond a task's own k best are dropped before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
