"""Job logs as streams. An addition: the batch operators in ``operators.state`` say the same for tables at rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from finsheet.sources.keyed import KeyedTable


def latest_states(events: DataFrame, job: str, at: str, status: str, tie: str) -> DataFrame:
    """Running latest status of each job; use output mode ``update`` or ``complete``."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.count(F.lit(1)).alias("n_events"))


def windowed_counts(events: DataFrame, at: str, kind: str, late: str | None = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by kind and window; rows later than ``late`` behind the newest are dropped and their state with them.

    ``late`` is None where the stream has a watermark already, as after ``once_each``.
    """
    return (events.withWatermark(at, late) if late else events).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))


def once_each(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


class _Lives(StatefulProcessor):
    """One job's life: its state goes with the final stage or when its timer is up."""

    STATE = "started long, last long, stage string, n long, cost double, stages map<string,long>"

    def __init__(self, timeout: int, final: tuple[str, ...]):
        self.timeout, self.final = timeout, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.life = handle, handle.getValueState("life", self.STATE)

    def _row(self, key, life: list, ended: int, status: str) -> pd.DataFrame:
        started, _, _, n, cost, stages = life
        return pd.DataFrame({"job": [key[0]], "started": [started], "ended": [ended], "status": [status], "n_events": [n], "cost": [cost], "stages": [stages]})

    def _given_up(self, key, life: list) -> pd.DataFrame:
        stages = {**life[5], life[2]: life[5].get(life[2], 0) + self.timeout}
        return self._row(key, [*life[:5], stages], life[1] + self.timeout, "expired")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows)).sort_values(["ms", "tie"], kind="stable")
        life = list(self.life.get()) if self.life.exists() else None
        if life:
            life[5] = dict(life[5])
            self.handle.deleteTimer(life[1] + self.timeout)
        for ms, stage, cost in zip(seen["ms"].tolist(), seen["stage"].fillna("").tolist(), seen["cost"].fillna(0.0).tolist(), strict=True):
            if life and ms - life[1] > self.timeout:
                yield self._given_up(key, life)
                life = None
            if life:
                life[5][life[2]] = life[5].get(life[2], 0) + ms - life[1]
                life = [life[0], ms, stage, life[3] + 1, life[4] + cost, life[5]]
            else:
                life = [ms, ms, stage, 1, cost, {}]
            life[5].setdefault(stage, 0)
            if stage in self.final:
                yield self._row(key, life, ms, stage)
                life = None
        if life:
            self.life.update(tuple(life))
            self.handle.registerTimer(life[1] + self.timeout)
        elif self.life.exists():
            self.life.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.life.exists():
            yield self._given_up(key, list(self.life.get()))
            self.life.clear()

    def close(self) -> None:
        pass


#: What ``job_lives_stream`` needs its session's state store to be.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def job_lives_stream(events: DataFrame, job: str, at: str, stage: str, cost: str, tie: str, timeout_seconds: int, final: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """The ended lives of ``operators.state.job_lives`` as they end: by a final stage, or by a timer when the watermark passes the timeout.

    The session must have STATE_STORE. Events later than ``late`` behind the newest are dropped. Output mode append.
    """
    kind = dict(events.dtypes)[job]
    own = events.where(F.col(at).isNotNull()).withWatermark(at, late).select(F.col(job).alias("job"), F.col(at), F.unix_millis(at).alias("ms"), F.col(stage).cast("string").alias("stage"), F.col(cost).cast("double").alias("cost"), F.col(tie).alias("tie"))
    schema = f"job {kind}, started long, ended long, status string, n_events long, cost double, stages map<string,long>"
    return own.groupBy("job").transformWithStateInPandas(_Lives(timeout_seconds * 1000, final), schema, "append", "eventTime")


def upsert_stream(events: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Keep a keyed table of the latest row per key; a micro-batch touches only the buckets of its keys. Stops when the input is read."""

    def merge(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, key, order, buckets).upsert(batch, number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
