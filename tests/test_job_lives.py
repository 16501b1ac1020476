"""Jobs' lives: the stream emits what the batch form says."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finsheet.operators import state
from finsheet.streaming import jobs

FINAL = ("purchase", "error")


@pytest.fixture
def rocks(spark):
    for k, v in jobs.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in jobs.STATE_STORE:
        spark.conf.unset(k)


def lives(rows):
    return sorted((r.job, r.started, r.ended, r.status, r.n_events, round(r.cost, 6), tuple(sorted(r.stages.items()))) for r in rows)


def run(spark, events, folder, name):
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = jobs.job_lives_stream(stream, "job", "ts", "event_type", "value", "event_id", 4 * 3600, FINAL).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name).collect()


def test_both_forms_are_equal_on_events(spark, sf, tmp_path, rocks):
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 40).alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    for i, days in enumerate(("01 to 08", "09 to 16", "17 to 24", "25 to 31")):  # files are read in the order of their age
        low, high = (int(d) for d in days.split(" to "))
        events.where(F.dayofmonth("ts").between(low, high)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    got = run(spark, events, str(tmp_path), "lives")
    now = events.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    want = state.job_lives(events, "job", "ts", "event_type", "value", "event_id", 4 * 3600, FINAL, F.lit(now)).where("status <> 'open'").collect()
    assert lives(got) == lives(want) and {r.status for r in got} == {*FINAL, "expired"}


def test_stages_timeouts_and_second_lives(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", at(0), "queued", 1.0, 1), ("a", at(1), "reading", 2.0, 2), ("a", at(3), "purchase", None, 3), ("a", at(3), "queued", 5.0, 4), ("b", at(0), "queued", None, 5), ("b", at(9), "reading", 1.0, 6), (None, at(1), None, 1.0, 7), ("c", None, "queued", 1.0, 8)]
    df = spark.createDataFrame(rows, "job string, ts timestamp, event_type string, value double, event_id int")
    out = state.job_lives(df, "job", "ts", "event_type", "value", "event_id", 4 * 3600, FINAL).collect()
    hour, zero = 3_600_000, int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1000)
    seen = {(r.job, (r.started - zero) // hour): (r.status, r.ended and (r.ended - zero) // hour, r.n_events, r.cost, {k: v // hour for k, v in r.stages.items()}) for r in out}
    assert seen == {
        ("a", 0): ("purchase", 3, 3, 3.0, {"queued": 1, "reading": 2, "purchase": 0}), ("a", 3): ("expired", 7, 1, 5.0, {"queued": 4}), ("b", 0): ("expired", 4, 1, None, {"queued": 4}),
        ("b", 9): ("open", None, 1, 1.0, {"reading": 4}), (None, 1): ("expired", 5, 1, 1.0, {"": 4}),
    }
