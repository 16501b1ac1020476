"""Consensus tables: state blobs, fiscal-year-end month, pivot by period, union with the latest actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.dates import epoch_month, period_end


def state_blob(html: Column, name: str = "__STATE__") -> Column:
    """JSON text assigned to ``window.<name>`` in a page, ``undefined`` values as null; NULL if there is none."""
    raw = F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(.*?)</script>", 1)
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r";\s*$", ""), r"(?<=[:,\[])undefined(?=[,}\]])", "null")
    return F.when(text != "", text)


def year_end_month(points: DataFrame, by: list[str], ms: str, pos: str) -> DataFrame:
    """The most frequent month of each group's dates; of equal ones the first seen."""
    month = points.select(*by, F.substring(epoch_month(ms), 6, 2).cast("int").alias("month"), pos)
    counted = month.groupBy(*by, "month").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    return counted.groupBy(*by).agg(F.max_by("month", F.struct("n", -F.col("first"))).alias("fye_month"))


def pivot_periods(points: DataFrame, by: list[str], ms: str, series: str, value: str, metrics: list[str], places: dict[str, int] | None = None) -> DataFrame:
    """Periods down, metrics across, each rounded half-even to its places (0 unless given); of several points of a period the last counts."""
    period = points.withColumn("period", epoch_month(ms))
    wide = period.groupBy(*by, "period").pivot(series, metrics).agg(F.max_by(value, ms))
    return wide.select(*by, "period", *[F.bround(m, (places or {}).get(m, 0)).alias(m) for m in metrics])


def annual_points(points: DataFrame, months: DataFrame, by: list[str], ms: str) -> DataFrame:
    """The points in each group's year-end month (``fye_month`` of ``months``); interim ones go, groups without a month keep all."""
    month = F.substring(epoch_month(ms), 6, 2).cast("int")
    return points.join(months, by, "left").where(F.col("fye_month").isNull() | (month == F.col("fye_month"))).drop("fye_month")


def with_actuals(forecast: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Forecast rows and the actual rows of periods that the forecast has not."""
    return forecast.unionByName(actual.join(forecast.select(key), key, "left_anti"), allowMissingColumns=True)


def summary(rows: DataFrame, by: list[str], period: str, excluded: str = "2029", n: int = 3) -> DataFrame:
    """The n newest periods of each group without the excluded year, with the period's last day."""
    order = Window.partitionBy(*by).orderBy(F.desc(period))
    kept = rows.where(~F.startswith(F.col(period), F.lit(excluded))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return kept.withColumn("period_end", period_end(period))


def growth(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Growth over the row before; no predecessor, a missing or a zero one gives NULL."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("growth", F.try_divide(F.col(value), before) - 1)
