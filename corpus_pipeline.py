"""A corpus pipeline of five stages, each written and read again before the next.

Every stage keeps the columns of ``documents`` as they are but for what it decides; the last one adds ``copy``. Defined cases, in
all stages: documents without an id are kept; null and empty texts are clean, hold no line, shingle or benchmark window, and have
no words, so the mix takes them at no cost or not at all; repeated rows are decided alike, except that of equal lines and equal
documents one stays; extra columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from finsheet.llm.common import drop, shared_dir, table
from finsheet.llm.decontaminate import drop_contaminated
from finsheet.llm.line_dedup import dedup_lines
from finsheet.llm.mixing import apply_mix
from finsheet.llm.ngram_join import keep_one_per_class
from finsheet.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected as toxic go; without labels nothing is learnt and nothing goes."""
    return drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go; every document stays, if need be with an empty text."""
    return dedup_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike, directly or through others, the one of smallest id stays."""
    return keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, none or up to three times, with its number in ``copy``."""
    return apply_mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("mixing", mixing)]

#: The stages fit models and draw by hashes, which SQL cannot say; the tests hold run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's files go when the next one's are written."""
    docs, folder, written = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written is not None:
            drop(written)
        written = docs
    return docs
