"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (with partial minima before the shuffle) and a join; the centre of a large star is a hot
key of that join and goes to all tasks instead. The links never leave the executors: only a count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.common import SMALL, drop, hot_join, materialise


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; component is the smallest node of its component.

    Null ends and links of a node to itself are no links; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        n = edges.count()
        written = []

        def kept(df: DataFrame, large: bool = n > SMALL, written: list = written) -> DataFrame:
            """Large tables that a hot join reads twice are written first."""
            if large:
                written.append(df := materialise(df, "stars"))
            return df

        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(_least_neighbours(both)).select("u", F.least("u", "m").alias("m"), "degree")
        large = kept(hot_join(both, low, "u", "degree", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = hot_join(large, kept(_least_neighbours(large)), "u", "degree", n)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        done, edges = edges, materialise(small, "links")
        drop(done, *written)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if before == (state.n, state["sum"]):
            break
        before = (state.n, state["sum"])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
