"""Streams, sinks and sources on files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from finsheet.operators import state
from finsheet.sources import readers, writers
from finsheet.sources.keyed import KeyedTable
from finsheet.streaming import jobs

EVENT = "job string, at timestamp, status string, n int"


def events(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(j, dt.datetime(2024, 1, d), s, n) for j, d, s, n in rows], EVENT).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


BATCHES = [[("a", 1, "queued", 1), ("b", 1, "queued", 2)], [("a", 2, "processing", 3), ("b", 3, "failed", 4)], [("a", 4, "completed", 5)]]


def test_latest_states_of_a_stream(spark, tmp_path):
    query = jobs.latest_states(events(spark, str(tmp_path), BATCHES), "job", "at", "status", "n").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.job, r.status, r.n_events) for r in spark.table("latest").collect()} == {("a", "completed", 3), ("b", "failed", 2)}


def test_upserts_of_a_stream(spark, tmp_path):
    query = jobs.upsert_stream(events(spark, str(tmp_path), BATCHES), f"{tmp_path}/out", f"{tmp_path}/ck", ["job"], ["at", "n"])
    query.awaitTermination(120)
    assert query.exception() is None
    assert {(r.job, r.status) for r in KeyedTable(spark, f"{tmp_path}/out", ["job"], ["at", "n"]).read().collect()} == {("a", "completed"), ("b", "failed")}


def test_windows_and_once_each(spark, tmp_path):
    stream = events(spark, str(tmp_path), [BATCHES[0], BATCHES[0]])
    query = jobs.windowed_counts(jobs.once_each(stream, "n", "at"), "at", "status", late=None).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_freshness(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(state.fresh(at("2024-01-01"), at("2024-01-02"), 86_400).alias("a"), state.fresh(at("2024-01-01"), at("2024-01-03"), 86_400).alias("b"), state.fresh(at("2000-01-01"), at("2024-01-03"), 0).alias("c")).first()
    assert tuple(row) == (True, False, True)


def test_delimited_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("code;name\n1;Açúcar\n2;B\n".encode("latin-1"))
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "r.csv")).collect()] == [("1", "Açúcar"), ("2", "B")]


def test_json_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"code": "1", "name": "A"},\n {"code": "2"}]')
    assert [tuple(r) for r in readers.json_registry(spark, str(tmp_path / "r.json"), "code string, name string").collect()] == [("1", "A"), ("2", None)]


def test_extractions_round_trip(spark, tmp_path):
    text = 'Here it is: {"company": "X", "period": "FY2025", "currency": "DKK", "plans": [{"plan_name": "P", "is_nil_cost": true, "closing_balance": 1,234.5, "tranches": [{"grant_date": "2023-02-01", "outstanding": 3.3, "exercise_price": 446},]}]} done'
    records = readers.extractions(spark.createDataFrame([("f", text)], "filing string, answer string"), ["filing"], "answer")
    writers.write_nested(records, ["filing"], str(tmp_path / "out"))
    parents, plans, tranches = readers.tables(spark, str(tmp_path / "none"), *[]) or (spark.read.parquet(f"{tmp_path}/out/{n}") for n in ("extractions", "plans", "tranches"))
    assert parents.first().company == "X" and plans.first().closing_balance == 1234.5 and tranches.first().outstanding == 3.3
    assert tranches.first().plan_id == plans.first().plan_id and plans.first().extraction_id == parents.first().extraction_id


def test_upsert_of_files_and_forecast_sink(spark, tmp_path):
    old, new = (spark.createDataFrame(rows, "k string, at int, v string") for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]))
    old.write.parquet(str(tmp_path / "0"))
    rows = writers.upsert_files(new, str(tmp_path / "0"), str(tmp_path / "1"), ["k"], ["at"])
    assert {tuple(r) for r in rows.collect()} == {("a", 2, "z"), ("b", 1, "y")}
    writers.write_forecast(rows, str(tmp_path / "f"), ["k", "v"])
    assert spark.read.json(str(tmp_path / "f/json")).columns == ["k", "v"]
