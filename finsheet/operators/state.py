"""Keyed state as tables: freshness, latest-wins upserts, job states, costs, error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a failure message contains, in the order tried, and its code.
FAILURES = (
    (("no relevant pages",), "NO_PAGES"),
    (("api key", "api_key"), "CONFIG"),
    (("company for",), "NOT_FOUND"),
    (("could not confidently identify", "could not resolve an ir site", "no gate-passing annual report", "could not find an annual report", "fetch failed", "resolve failed"), "NO_REPORT"),
)


def fresh(cached_at: Column, as_of: Column, ttl_seconds: int) -> Column:
    """Whether an entry still counts; a ttl of 0 or less never expires."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(cached_at)
    return F.lit(True) if ttl_seconds <= 0 else age <= ttl_seconds


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__u"))
    return best.select(*key, *[F.col(f"__u.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Old and new entries, the latest of each key."""
    return latest(old.unionByName(new, allowMissingColumns=True), key, order)


def job_states(events: DataFrame, job: str, at: str, status: str, tie: str) -> DataFrame:
    """Per job its latest status, number of events and seconds from first to last."""
    span = F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))
    return events.groupBy(job).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.count(F.lit(1)).alias("n_events"), span.alias("seconds"))


def job_lives(events: DataFrame, job: str, at: str, stage: str, cost: str, tie: str, timeout_seconds: int, final: tuple[str, ...], as_of: Column | None = None) -> DataFrame:
    """(job, started, ended, status, n_events, cost, stages): what became of each job, times in epoch milliseconds.

    A job lives from its first event to a ``final`` stage, or until ``timeout_seconds`` have passed without one, when it is evicted;
    later events of that id are another job. status is the final stage, ``expired``, or ``open`` where the time is not up at
    ``as_of`` (the newest event unless given). stages has the milliseconds spent in each stage, until the next event or the end.
    """
    order, timeout = Window.partitionBy(job).orderBy("__ms", tie), timeout_seconds * 1000
    rows = events.select(job, stage, cost, tie, F.unix_millis(F.col(at).cast("timestamp")).alias("__ms")).where("__ms is not null")
    before = F.lag(F.struct("__ms", F.col(stage).alias("s"))).over(order)
    first = before.isNull() | (F.col("__ms") - before["__ms"] > timeout) | F.coalesce(before["s"].isin(*final), F.lit(False))
    rows = rows.withColumn("__first", first.cast("int")).withColumn("__life", F.sum("__first").over(order))
    following = F.lead("__ms").over(Window.partitionBy(job, "__life").orderBy("__ms", tie))
    ends = F.coalesce(F.col(stage).isin(*final), F.lit(False))
    stays = F.coalesce(following - F.col("__ms"), F.when(ends, 0).otherwise(timeout))
    each = rows.withColumn("__stays", stays.cast("long"))
    part = each.groupBy(job, "__life", stage).agg(F.sum("__stays").alias("ms"), F.min("__ms").alias("started"), F.max(F.struct("__ms", tie)).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(cost).alias("c"))
    life = part.groupBy(job, "__life").agg(F.min("started").alias("started"), F.max(F.struct("last", stage)).alias("end"), F.sum("n").alias("n_events"), F.sum("c").alias("cost"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(stage).cast("string"), F.lit("")).alias("stage"), "ms")))).alias("stages"))
    now = F.unix_millis(as_of.cast("timestamp")) if as_of is not None else F.lit(rows.agg(F.max("__ms")).first()[0])  # one number
    over, due = F.coalesce(F.col(f"end.{stage}").isin(*final), F.lit(False)), F.col("end.last.__ms") + timeout
    status = F.when(over, F.col(f"end.{stage}")).when(due < now, "expired").otherwise("open")
    return life.select(job, "started", F.when(over, F.col("end.last.__ms")).when(due < now, due).alias("ended"), status.alias("status"), "n_events", "cost", "stages")


def cost(rows: DataFrame, by: list[str], tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, places: int = 4) -> DataFrame:
    """Tokens and cost (prices per million tokens, rounded half-even)."""
    total = F.sum(tokens_in), F.sum(tokens_out)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), total[0].alias("tokens_in"), total[1].alias("tokens_out"), F.bround(total[0] / 1e6 * price_in + total[1] / 1e6 * price_out, places).alias("cost"))


def listing(jobs: DataFrame, by: list[str], status: str) -> DataFrame:
    """Per group how many jobs there are, and how many of each status as a map."""
    counted = jobs.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(status).cast("string"), F.lit("")), "n")))).alias("by_status"))


def counters(calls: DataFrame, by: list[str], kind: str, credits: dict[str, int], otherwise: int) -> DataFrame:
    """Calls of each group and the credits they cost by their kind."""
    price = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in credits.items() for x in kv]), F.col(kind)), F.lit(otherwise))
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(price).cast("long").alias("credits"))


def failure_code(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    code = F
    for words, name in FAILURES:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        if name == "NOT_FOUND":
            found = found & F.contains(low, F.lit("could not find a"))
        code = code.when(found, name)
    return code.otherwise("UNKNOWN")


def keep_all_on_failures(rows: DataFrame, by: list[str], failed: str, keep: str, most: int = 5) -> DataFrame:
    """Where ``most`` or more rows of a group failed the classifier is taken to be down: all its rows are kept, with a reason."""
    down = F.count_if(F.col(failed)).over(Window.partitionBy(*by)) >= most
    return rows.withColumn("__down", down).withColumns({keep: F.col("__down") | F.col(keep), "reason": F.when(F.col("__down"), F.lit("classifier-down"))}).drop("__down")


def evicted(rows: DataFrame, written: str, now: Column, ttl_seconds: int) -> DataFrame:
    """What a write leaves of a cache: entries that have not outlived their time."""
    return rows.where(F.unix_timestamp(now) - F.unix_timestamp(written) <= ttl_seconds)
