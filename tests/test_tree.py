"""JSON of unknown depth."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from finsheet.operators import tree


def walk(value, path="$", depth=0):
    """Every (path, depth, key) below a value, by recursion."""
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}["{k}"]'
            out += [(at, depth + 1, k), *walk(v, at, depth + 1)]
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += [(f"{path}[{i}]", depth + 1, None), *walk(v, f"{path}[{i}]", depth + 1)]
    return out


def deep(n):
    return {"k": n} if n == 0 else {"a": [deep(n - 1), n]}


def test_every_node_at_any_depth(spark):
    docs = [{"a": {"b": [1, {"b": None}]}, "x y": {"b": "s"}}, deep(30), [], 5, [[[]], {"": {"ü": 1}}], {"p": [{"q": [{"r": [1, 2]}]}]}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{not json"), (92, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = sorted((r.id, r.path, r.depth, r.key or "") for r in tree.nodes(df, ["id"], F.col("t")).collect())
    want = sorted((i, p, d, k or "") for i, doc in enumerate(docs) for p, d, k in [("$", 0, None), *walk(doc)])
    assert got == want


def test_levels_below_the_deepest_are_not_entered(spark):
    df = spark.createDataFrame([(1, json.dumps(deep(50)))], "id int, t string")
    assert tree.nodes(df, ["id"], F.col("t"), deepest=10).agg(F.max("depth")).first()[0] == 10


def test_series_of_a_block_that_stands_anywhere(spark):
    """The block is known by what it holds; a text or null under the key is none, and points that are no numbers go."""
    state = {"data": [{"merged_future_revenue": None}, {"analysis": {"future": {"merged_future_revenue": {"1798675200000": 5.5, "1830211200000": None, "note": 1}, "merged_future_eps": {"1798675200000": 2}}}}]}
    html = f"<html><script>window.__STATE__ = {json.dumps(state)[:-1]}, \"u\":undefined}};</script></html>"
    pages = spark.createDataFrame([("A", html), ("B", "<html></html>"), ("C", None)], "id string, html string")
    found = tree.state_nodes(pages, ["id"], "html")
    block = tree.holders(found, ["id"], "merged_future_revenue")
    assert [tuple(r) for r in block.collect()] == [("A", "$.data[1].analysis.future")]
    points = tree.series(found, ["id"], block, {"merged_future_revenue": "revenue", "merged_future_eps": "eps"})
    assert sorted(tuple(r) for r in points.collect()) == [("A", "eps", 1798675200000, 2.0), ("A", "revenue", 1798675200000, 5.5)]


def test_every_partition_is_walked_where_it_is(spark):
    """The walk shuffles and gathers nothing, so a task reads no more documents than before."""
    df = spark.createDataFrame([(i, json.dumps(deep(2))) for i in range(100)], "id int, t string").repartition(40)
    found = tree.nodes(df, ["id"], F.col("t"))
    assert found.rdd.getNumPartitions() == 40 and found.count() == 100 * (1 + len(walk(deep(2))))


def test_brackets_in_strings_are_no_levels(spark):
    texts = [json.dumps({"a": '[[{"\\', "[": [1]}), "[[],[[1]]]", "3", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(tree.levels(F.col("t"))).collect()] == [2, 3, 0, 0]
