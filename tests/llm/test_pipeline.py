"""The five stages, one by one and together."""

from __future__ import annotations

import corpus_pipeline
from finsheet.llm.decontaminate import contaminated
from finsheet.llm.mixing import mix_sources
from finsheet.llm.ngram_join import ngram_classes
from finsheet.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.01"


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "mixing":
            assert docs.columns == columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert bad and ids(docs) == [i for i in ids(before) if i not in bad]
        elif name == "line_dedup":
            assert ids(docs) == ids(before)
            lines = lambda df: sum((r.text or "").count("\n") for r in df.select("text").collect())
            assert lines(docs) < lines(before)
        elif name == "ngram_join":
            assert ids(docs) == sorted(r.doc_id for r in ngram_classes(before).where("doc_id = class_id").collect())
        elif name == "decontamination":
            gone = {r.doc_id for r in contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert gone and ids(docs) == [i for i in ids(before) if i not in gone]
        else:
            copies = {r.doc_id: r.copies for r in mix_sources(before).collect()}
            assert ids(docs) == sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_awkward_documents_pass_through(docs, spark, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    assert docs.count() > 0


def test_empty_tables_pass_through(spark, tmp_path):
    """Empty documents, labels and benchmark: every stage gives an empty table with the columns it should have."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert docs.count() == 0 and docs.columns == (columns + ["copy"] if name == "mixing" else columns)
