"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.llm import llm_sql
from finsheet.llm.ann_tree import nearest
from finsheet.llm.common import table
from finsheet.llm.decontaminate import contaminated
from finsheet.llm.langid import languages
from finsheet.llm.line_dedup import line_report
from finsheet.llm.mixing import mix_sources
from finsheet.llm.ngram_join import ngram_classes
from finsheet.llm.quality_fm import quality_scores
from finsheet.llm.resampling import resample
from finsheet.llm.suffix_dedup import suffix_dedup
from finsheet.llm.token_scan import rank_encoder, read_blocks, scan, write_flat
from finsheet.llm.toxicity import toxicity_scores
from finsheet.llm.url_filters import RULE, judged
from finsheet.llm.vector_codes import vector_codes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: Host, path and verdict of the rules that pages are judged by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: doc_id, n_tokens, as the separator scan finds them in flat token files of all documents.

    The flat files have no index; which document a separator ends is known only from the order of writing.
    """
    folder, order = write_flat(table(spark, sf_dir, "documents"), rank_encoder(vocabulary), END_OF_DOCUMENT)
    counts = scan(read_blocks(spark, folder), END_OF_DOCUMENT).withColumn("shard", F.substring_index("shard", "/", -1))
    order = order.select("shard", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("shard", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return order.join(counts, ["shard", "ordinal"]).select("doc_id", "n_tokens")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_suffix_dedup, op3_line_dedup, op4_nearest_neighbours, op5_mixing, op6_token_counts, op7_quality, op8_toxicity, op9_ngram_join, op10_language, op11_url_filters, op12_vector_codes, op13_resampling)
}

#: The others are not said by SQL (hash-drawn choices, fitted models, tokenizers, approximate search): the tests hold each
#: against brute force instead.
ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": llm_sql.OP2, "op3_line_dedup": llm_sql.OP3, "op9_ngram_join": llm_sql.OP9, "op11_url_filters": llm_sql.OP11, "op12_vector_codes": llm_sql.OP12, "op13_resampling": llm_sql.OP13}
