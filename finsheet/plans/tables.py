"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over four partitions for each part that the table ``source`` is read in, and at least the session's.

    A task's share then stays the same as the table grows, and what is grouped by the keys or more is not shuffled again.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, 4 * source.rdd.getNumPartitions()), *keys)
