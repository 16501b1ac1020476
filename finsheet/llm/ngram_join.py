"""N-gram Jaccard self-join of documents by a MinHash LSH forest, with exact verification.

A document is its set of hashed five-word shingles. Equal sets are one class, represented by their smallest id, so
copies are never compared. Each representative has a label of DEPTH minima per tree of the forest. A tree is the trie of
its labels: a node is a prefix, its members the rows that begin with it, and two documents meet in a tree when they share a
node. The matched prefix starts at full depth and is shortened until pairs just at the threshold, the hardest to find,
meet as often as the recall asks for, so every more similar pair does whatever the data hold. Documents that meet anywhere are first put into one candidate component through their tries' nodes (a node with any
number of members costs one row per member, never pairs). Components are then verified exactly: their members are
dealt into blocks, each pair of blocks is one task's work, and a task counts common shingles by a matrix product.

Output per document: its class (the smallest id of those linked to it, directly or through others) and how many other
documents have Jaccard similarity of at least the threshold with it; copies are counted, not expanded.

Defined cases: null and empty texts and texts without a word have no shingles, are linked to nothing and are their
own class; a text of fewer than five words is one shingle; repeated ids are one document each time with equal
results for equal texts (ids are expected to be distinct); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.common import drop, hot_join, materialise
from finsheet.llm.components import connected_components
from finsheet.llm.kernel import mix, pieces, shingles

TREES, DEPTH = 20, 8
_turn = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def met_in_some_tree(similarity, length: int, trees: int = TREES):
    """The chance that two documents of this similarity share a prefix of ``length`` minima in some tree."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** length) ** trees


def prefix_length(seen: list[tuple[float, float]], threshold: float, recall: float, edge: float = 0.99, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix whose recall over the similarities ``seen`` (similarity, weight) reaches ``recall``.

    Pairs just at the threshold must meet with a chance of ``edge`` besides, whatever the sample holds.
    """
    s, w = (np.array(x, dtype=float) for x in zip(*seen, strict=True)) if seen else (np.array([threshold]), np.ones(1))
    length = depth
    while length > 1 and (np.sum(w * met_in_some_tree(s, length, trees)) < recall * np.sum(w) or met_in_some_tree(threshold, length, trees) < edge):
        length -= 1
    return length


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set_key, size, labels): labels has a row of DEPTH minima, 4 bytes each, for every tree.

    Equal prefixes of labels are a trie node.
    """

    def sketch(batches):
        for batch in pieces(batches, most=1_500_000):
            values, offsets = shingles(batch.column("text"), n)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            order = np.lexsort((values, doc))
            values, doc = values[order], doc[order]
            new = np.ones(len(values), dtype=bool)
            new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
            values, doc = values[new], doc[new]
            size = np.bincount(doc, minlength=batch.num_rows)
            full = np.flatnonzero(size)
            if not len(full):
                continue
            start = np.searchsorted(doc, full)
            key = np.column_stack([np.add.reduceat(mix(values ^ np.uint64(s)), start) for s in (0x51ED27, 0xA5A5A5A5)])
            labels = np.zeros((len(full), TREES * DEPTH), dtype=np.uint32)
            for t in range(TREES * DEPTH):
                labels[:, t] = mix(np.minimum.reduceat(values * _turn[t], start)) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(full)), pa.array([k.tobytes() for k in key], pa.binary()), pa.array(size[full], pa.int64()), pa.array([x.tobytes() for x in labels.byteswap()], pa.binary())],
                names=["doc_id", "set_key", "size", "labels"],
            )

    return docs.mapInArrow(sketch, "doc_id long, set_key binary, size long, labels binary")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(all columns of docs but text, sorted distinct shingle hashes as bytes)."""
    kept = [c for c in docs.columns if c != "text"]

    def sets(batches):
        for batch in pieces(batches):
            values, offsets = shingles(batch.column("text"), n)
            own = [np.unique(values[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(own, pa.binary())], names=[*kept, "shingles"])

    return docs.mapInArrow(sets, ", ".join(f"{c} {t}" for c, t in docs.select(kept).dtypes) + ", shingles binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Matrix of the sizes of the intersections of sorted sets; shingles of one document only are left out first."""
    n, m = len(left), len(right)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    group = np.cumsum(np.append(0, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=int)
    keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
    owner, group = owner[keep], group[keep]
    out = np.zeros((n, m), dtype=np.float32)
    if not len(group):
        return out
    _, group = np.unique(group, return_inverse=True)
    for at in range(0, group[-1] + 1, width):
        a, b = np.searchsorted(group, [at, at + width])
        x = np.zeros((n + m, width), dtype=np.float32)
        x[owner[a:b], group[a:b] - at] = 1
        out += x[:n] @ x[n:].T
    return out


def _verify(threshold: float):
    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        """Exact Jaccard of the pairs of two blocks: per document its links, and a spanning set of links."""
        frame = frame.sort_values("doc_id", ignore_index=True)
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        left = frame if i == j else frame[frame["block"] == i].reset_index(drop=True)
        right = frame if i == j else frame[frame["block"] == j].reset_index(drop=True)
        sets = lambda f: [np.frombuffer(x, dtype=np.uint64) for x in f["shingles"]]
        common = common_counts(sets(left), sets(right))
        total = left["size"].to_numpy()[:, None] + right["size"].to_numpy()[None, :] - common
        linked = common >= threshold * total - 1e-6
        if i == j:
            np.fill_diagonal(linked, False)
        a, b = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
        out = [pd.DataFrame({"doc_id": a, "links": linked @ right["copies"].to_numpy(), "to": _first(linked, b)})]
        if i != j:
            out.append(pd.DataFrame({"doc_id": b, "links": linked.T @ left["copies"].to_numpy(), "to": _first(linked.T, a)}))
        # Each row's first partner need not span the tile; the rest of the spanning links come from a union-find.
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for part in out:
            for x, y in zip(part["doc_id"].tolist(), part["to"].tolist(), strict=True):
                if y >= 0 and (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
        extra = []
        roots_a, roots_b = np.array([root(x) for x in a.tolist()]), np.array([root(x) for x in b.tolist()])
        for x, y in zip(*np.nonzero(linked & (roots_a[:, None] != roots_b[None, :])), strict=True):
            if (p := root(int(a[x]))) != (q := root(int(b[y]))):
                parent[max(p, q)] = min(p, q)
                extra.append((int(a[x]), 0, int(b[y])))
        out.append(pd.DataFrame(extra, columns=["doc_id", "links", "to"]))
        found = pd.concat(out)
        return found[found["to"] >= 0].astype({"doc_id": "int64", "links": "int64", "to": "int64"})

    return tile


def _first(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.where(linked.any(axis=1), ids[linked.argmax(axis=1)] if len(ids) else -1, -1)


def trie_nodes(reps: DataFrame, length: int) -> DataFrame:
    """(node, doc_id): the trie node of every representative in every tree at the given depth."""
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("labels"), t * (4 * DEPTH) + 1, F.lit(4 * length))))
    return reps.select("doc_id", F.explode(prefixes).alias("node"))


def ngram_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 192) -> DataFrame:
    """Per document: doc_id, class_id, n_links, rep_id (the representative of its set of shingles), n_shingles."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialise(sketches(own, n), "sketches")
    sets = materialise(sketched.groupBy("set_key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies")), "sets")
    member = materialise(hot_join(sketched.select("doc_id", "set_key", "size"), sets, "set_key", "copies", sketched.count()).select("doc_id", "rep_id", "copies", "size"), "members")
    drop(sets)
    reps = member.where("doc_id = rep_id").dropDuplicates(["doc_id"])
    signed = materialise(sketched.join(reps.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "labels"), "signatures")
    drop(sketched)
    length = prefix_length([(threshold, 1.0)], threshold, recall)
    # One row per representative and tree; a trie node with a single representative links nothing.
    nodes = trie_nodes(signed, length)
    met = materialise(nodes.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high").drop("high"), "nodes")
    star = hot_join(nodes, met, "node", "members", TREES * signed.count()).where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    candidates = materialise(connected_components(star), "candidates")
    drop(met, signed)
    counted = candidates.groupBy("component").count()
    dealt = candidates.join(counted, "component").select(
        F.col("node").alias("doc_id"), "component",
        F.ceil(F.col("count") / block).alias("blocks"), F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("count") / block)).alias("block"),
    )
    dealt = dealt.join(reps.select("doc_id", "size", "copies"), "doc_id")
    # Block b is needed by the tiles (b, j) for j >= b and (i, b) for i < b.
    with_text = shingle_sets(own.join(dealt, "doc_id"), n)
    with_text = materialise(with_text, "sets")
    tiles = with_text.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    found = materialise(tiles.groupBy("component", "i", "j").applyInPandas(_verify(threshold), "doc_id long, links long, to long"), "verified")
    drop(with_text, candidates)
    links = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    classes = connected_components(found, "doc_id", "to")
    result = member.join(links, member["rep_id"] == links["doc_id"], "left").drop(links["doc_id"])
    result = result.join(classes, result["rep_id"] == classes["node"], "left")
    result = result.select("doc_id", F.coalesce("component", "rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "rep_id", F.col("size").alias("n_shingles"))
    rest = own.select("doc_id").join(member.select("doc_id"), "doc_id", "left_anti")
    return result.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_shingles")))


def keep_one_per_class(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Documents that are the smallest id of their class, whole and with their columns; null ids are kept."""
    dropped = ngram_classes(docs, n, threshold).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
