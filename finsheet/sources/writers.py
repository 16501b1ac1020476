"""Sinks: nested records to parent, child and grandchild tables, keyed upserts, forecast files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.operators.state import upsert


def split_nested(extractions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(extractions, plans, tranches) with keys made of hashes of natural keys, so that a rerun gives the same ones."""
    own = extractions.withColumn("extraction_id", F.xxhash64(*key))
    parents = own.drop("plans")
    plans = own.select("extraction_id", F.posexplode("plans").alias("plan_index", "p")).select("extraction_id", F.xxhash64("extraction_id", "plan_index").alias("plan_id"), "plan_index", "p.*")
    tranches = plans.select("plan_id", F.posexplode("tranches").alias("tranche_index", "t")).select("plan_id", "tranche_index", "t.*")
    return parents, plans.drop("tranches"), tranches


def write_nested(extractions: DataFrame, key: list[str], folder: str) -> None:
    for name, df in zip(("extractions", "plans", "tranches"), split_nested(extractions, key), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_merged(spark, path: str) -> DataFrame:
    """A table whose files gained columns over time."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def upsert_files(new: DataFrame, path: str, target: str, key: list[str], order: list[str]) -> DataFrame:
    """Latest of each key of the table at ``path`` and ``new``, written to ``target`` (another folder) and read back."""
    spark = new.sparkSession
    upsert(spark.read.parquet(path), new, key, order).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_forecast(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """Fixed columns as JSON lines and CSV; extra columns are ignored."""
    fixed = rows.select(*columns)
    fixed.write.mode("overwrite").json(f"{folder}/json")
    fixed.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
