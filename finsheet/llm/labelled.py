"""Bounded samples of labelled rows, the only rows a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(``docs`` with the column label, labelled rows only; how many usable rows each class has).

    At most about ``per_class[y]`` rows of class y are taken, chosen by a hash of the id: the bound is a parameter
    and holds at any input size. Null labels and ids take no part; of repeated labels the largest counts.
    """
    own = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(usable)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {int(r[0]): int(r[1]) for r in own.groupBy("label").count().collect()}
    pick = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003))
    share = F.lit(0)
    for y, most in per_class.items():
        share = F.when(F.col("label") == y, F.lit(int(1_000_003 * min(1.0, most / max(1, counts.get(y, 1)))))).otherwise(share)
    chosen = own.where(pick < share)  # at most the bound, so it is small enough to send everywhere
    return docs.join(F.broadcast(chosen), "doc_id").where("text is not null"), counts
