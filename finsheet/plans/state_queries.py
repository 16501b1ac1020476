"""Caches, jobs, costs and nested data over the driver tables: events are log entries, conversations are calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.functions import text
from finsheet.operators import state, tree
from finsheet.plans.tables import table
from finsheet.sources import keyed


def cache_ttl_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last week, the newest of each key; the second half of the ids is the batch of new entries."""
    events = table(spark, sf_dir, "events").select(text.cache_key("event_type", F.col("user_id").cast("string")).alias("key"), "ts", "event_id", "value")
    fresh = events.where(state.fresh(F.col("ts").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp"), 7 * 86_400))
    merged = state.upsert(fresh.where("event_id % 2 = 0"), fresh.where("event_id % 2 = 1"), ["key"], ["ts", "event_id"])
    return merged.select("key", "event_id", "value")


CACHE_TTL_UPSERT = """
WITH e AS (SELECT substr(sha256(event_type || chr(0) || user_id), 1, 32) AS key, event_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) <= 7 * 86400)
SELECT key, event_id, value FROM e WHERE k = 1"""


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as three batches of a keyed table (in no order of their ids): the newest event of each user and type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    kept = keyed.KeyedTable(spark, keyed.scratch(spark, "keyed"), ["user_id", "event_type"], ["event_id"], buckets=16)
    for i in range(3):
        kept.upsert(events.where(F.col("event_id") % 3 == (2 * i) % 3))
    return kept.read()


KEYED_UPSERT = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL"


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("job"), F.col("ts").cast("timestamp").alias("at"), "event_type", "event_id")
    return state.job_states(events, "job", "at", "event_type", "event_id")


JOB_STATE = """
SELECT event_id % 500 AS job, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1"""


def job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as jobs: how each ended, and how long it was in which stage."""
    lives = state.job_lives(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "value", "event_id", 4 * 3600, ("purchase", "error"))
    stages = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return lives.select("user_id", "started", "ended", "status", "n_events", F.bround("cost", 2).alias("cost"), stages.alias("stages"))


JOB_LIVES = """
WITH e AS (SELECT user_id, event_id, event_type AS s, value, epoch_us(ts) // 1000 AS ms FROM events),
b AS (SELECT *, lag(ms) OVER w AS before, lag(s) OVER w AS stage FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
f AS (SELECT *, CASE WHEN before IS NULL OR ms - before > 14400000 OR stage IN ('purchase', 'error') THEN 1 ELSE 0 END AS first FROM b),
l AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS life FROM f),
n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id, life ORDER BY ms, event_id) AS next FROM l),
d AS (SELECT user_id, life, s, CAST(sum(CASE WHEN next IS NOT NULL THEN next - ms WHEN s IN ('purchase', 'error') THEN 0 ELSE 14400000 END) AS BIGINT) AS ms FROM n GROUP BY ALL),
g AS (SELECT user_id, life, string_agg(s || '=' || ms, ' ' ORDER BY s) AS stages FROM d GROUP BY ALL),
a AS (SELECT user_id, life, min(ms) AS started, max(ms) AS last, arg_max(s, (ms, event_id)) AS s, count(*) AS n_events, sum(value) AS cost FROM n GROUP BY ALL),
t AS (SELECT max(ms) AS now FROM e)
SELECT user_id, started, CASE WHEN s IN ('purchase', 'error') THEN last WHEN last + 14400000 < now THEN last + 14400000 END AS ended, CASE WHEN s IN ('purchase', 'error') THEN s WHEN last + 14400000 < now THEN 'expired' ELSE 'open' END AS status,
       n_events, round_even(cost, 2) AS cost, stages FROM a JOIN g USING (user_id, life), t"""


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ("No relevant pages in it", "Missing API key", "Could not find a Danish company for 'X'", "Fetch failed: 404", "something else", "could not find an annual report on this site")
    message = F.element_at(F.array(*[F.lit(m) for m in messages]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("code", state.failure_code(message))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


ERROR_CODES = """
WITH e AS (SELECT event_id, ['NO_PAGES', 'CONFIG', 'NOT_FOUND', 'NO_REPORT', 'UNKNOWN', 'NO_REPORT'][event_id % 6 + 1] AS code FROM events)
SELECT code, count(*) AS n, min(event_id) AS first FROM e GROUP BY code"""


def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as jobs: how many, and how many of each kind."""
    listed = state.listing(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return listed.select("user_id", "total", *[F.coalesce(F.try_element_at("by_status", F.lit(k)), F.lit(0)).alias(k) for k in ("click", "purchase", "error")])


JOB_LISTING = """
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id"""


def call_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches: views cost five credits, clicks two, others one."""
    return state.counters(table(spark, sf_dir, "events"), ["user_id"], "event_type", {"view": 5, "click": 2}, 1)


CALL_COUNTERS = "SELECT user_id, count(*) AS calls, CAST(sum(CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 2 ELSE 1 END) AS BIGINT) AS credits FROM events GROUP BY user_id"


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write at the newest event's time leaves of a cache of two days."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    now = events.agg(F.max("at")).first()[0]  # one value
    return state.evicted(events, "at", F.lit(now), 2 * 86_400).select("event_id")


CACHE_EVICTION = "SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE floor(epoch(now)) - floor(epoch(ts)) <= 2 * 86400"


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    side = lambda r: F.when(F.col("role") == r, F.col("n")).otherwise(0)
    return state.cost(rows, ["conv_id"], side("user"), side("assistant"), 3.0, 15.0, places=6)


COST_ROLLUP = """
WITH c AS (SELECT conv_id, count(*) AS calls, coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS i, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS o FROM conversations GROUP BY conv_id)
SELECT conv_id, calls, CAST(i AS BIGINT) AS tokens_in, CAST(o AS BIGINT) AS tokens_out, round_even(i / 1e6 * 3.0 + o / 1e6 * 15.0, 6) AS cost FROM c"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values by path, schema known."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


JSON_PROPS = """
SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY event_type"""


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, json): a customer's orders with their lines as one JSON text."""
    line = F.struct(F.col("l_partkey").alias("part"), F.struct(F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax")).alias("amount"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), "lines")
    return orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(order).alias("orders")).alias("book"))).alias("json"))


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as JSON texts: every value under the keys price and tax, wherever it stands, by the shape of its path."""
    found = tree.under_key(tree.nodes(_nested_orders(spark, sf_dir), ["o_custkey"], F.col("json")), F.col("key").isin("price", "tax"))
    shape = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    amount = F.try_variant_get("value", "$", "double")
    return found.groupBy("o_custkey", shape.alias("shape"), F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(amount), 2).alias("total"))


TREE_WALK = """
WITH v AS (SELECT o_custkey, '$.book.orders[].price' AS shape, 4 AS depth, o_totalprice AS x FROM orders
    UNION ALL SELECT o_custkey, '$.book.orders[].lines[].amount.price', 7, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    UNION ALL SELECT o_custkey, '$.book.orders[].lines[].amount.tax', 7, l_tax FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_custkey, shape, CAST(depth AS BIGINT) AS depth, count(*) AS n, round_even(sum(x), 2) AS total FROM v GROUP BY ALL"""


def state_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that carry a customer's orders as the state of a script: the block that holds a series, wherever it is, and its points."""
    ms = (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")
    points = table(spark, sf_dir, "orders").groupBy("o_custkey", ms.alias("ms")).agg(F.max("o_totalprice").alias("v"))
    points = points.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("ms", "v"))).alias("revenue"))
    blob = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("x"), F.struct(F.col("revenue").alias("merged_revenue"), F.lit("y").alias("note")).alias("future"))).alias("company")))
    pages = table(spark, sf_dir, "pages").join(points, F.col("page_id") == F.col("o_custkey"))
    pages = pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("<script>window.__STATE__ = "), blob, F.lit(";</script>")).alias("html"))
    found = tree.state_nodes(pages, ["page_id"], "html")
    block = tree.holders(found, ["page_id"], "merged_revenue")
    return tree.series(found, ["page_id"], block, {"merged_revenue": "revenue"}).groupBy("page_id", "series").agg(F.count(F.lit(1)).alias("points"), F.max("ms").alias("newest"), F.max_by("value", "ms").alias("value"))


STATE_WALK = """
WITH o AS (SELECT o_custkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) * 1000 AS ms, max(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT page_id, 'revenue' AS series, count(*) AS points, max(ms) AS newest, arg_max(v, ms) AS value FROM pages JOIN o ON o_custkey = page_id GROUP BY page_id"""


def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per namespace and day."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("user_id").alias("users"))


CACHE_STATISTICS = """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS entries, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"""
