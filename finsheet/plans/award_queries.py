"""Award-plan queries over the driver tables: line items play plans, events their flows, orders filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsheet.operators import facts, merge, plans
from finsheet.plans.tables import dealt, table

def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plans: flag gives the unit, status and discount whether the award is nil-cost."""
    nil = F.when(F.col("l_linestatus") == "O", True).when(F.col("l_discount") > 0.05, False)
    units = F.when(F.col("l_returnflag") == "A", "thousands").when(F.col("l_returnflag") == "R", "millions")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.lit("PLAN").alias("plan_type"), nil.alias("is_nil_cost"), units.alias("units_label"),
        F.col("l_quantity").alias("closing_balance"), F.col("l_extendedprice").alias("weighted_avg_exercise_price"), F.col("l_extendedprice").alias("weighted_avg_grant_date_fair_value"),
        F.nullif("l_tax", F.lit(0.0)).alias("weighted_avg_remaining_contractual_life_years"), F.nullif("l_discount", F.lit(0.0)).alias("vesting_period_years"),
        F.nullif("l_tax", F.lit(0.0)).alias("weighted_avg_expense_recognition_years"),
    )


_TIE = ["l_partkey", "l_suppkey", "l_linenumber", "strike"]
_PLAN_SQL = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price, NULLIF(l_tax, 0) AS life, NULLIF(l_discount, 0) AS vest,
           CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN l_quantity / 1000.0 ELSE l_quantity / 1000000.0 END AS count_mn,
           CASE WHEN l_linestatus = 'O' THEN TRUE WHEN l_discount > 0.05 THEN FALSE END AS nil
    FROM lineitem"""


def plan_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans.top_plans(plans.sanitise(plans.classify(_plans(spark, sf_dir))), ["l_orderkey"], _TIE)
    return rows.select("l_orderkey", F.col("rank").cast("long").alias("rank"), "l_partkey", "kind", F.bround("count_mn", 9).alias("count_mn"), "strike", "maturity_years")


PLAN_TOPN = f"""
WITH p AS ({_PLAN_SQL}),
r AS (SELECT *, CASE WHEN nil THEN 'rsu' ELSE 'option' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY count_mn DESC, l_partkey, l_suppkey, l_linenumber, price) AS rank
      FROM p WHERE nil IS NOT NULL AND count_mn > 0 AND price > 0)
SELECT l_orderkey, rank, l_partkey, kind, round(count_mn, 9) AS count_mn, price AS strike, coalesce(life, vest, 4.0) AS maturity_years FROM r WHERE rank <= 3"""


def plan_strict_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans.strict(_plans(spark, sf_dir))
    return rows.groupBy("kind", "strike_field", "maturity_field").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(F.col("strike").cast("decimal(18,2)")).cast("double"), 2).alias("strike_sum"), F.max("maturity_years").alias("longest"))


PLAN_STRICT_CHAIN = f"""
WITH p AS ({_PLAN_SQL} WHERE l_quantity > 0),
s AS (SELECT CASE WHEN nil THEN 'rsu' ELSE 'option' END AS kind, price AS strike,
             CASE WHEN nil THEN 'weighted_avg_grant_date_fair_value' ELSE 'weighted_avg_exercise_price' END AS strike_field,
             CASE WHEN nil THEN coalesce(vest, life) ELSE coalesce(life, vest) END AS maturity_years,
             CASE WHEN nil THEN CASE WHEN vest IS NOT NULL THEN 'vesting_period_years' WHEN life IS NOT NULL THEN 'weighted_avg_expense_recognition_years' END
                  ELSE CASE WHEN life IS NOT NULL THEN 'weighted_avg_remaining_contractual_life_years' WHEN vest IS NOT NULL THEN 'vesting_period_years' END END AS maturity_field
      FROM p)
SELECT kind, strike_field, maturity_field, count(*) AS n, CAST(sum(CAST(strike AS DECIMAL(18,2))) AS DOUBLE) AS strike_sum, max(maturity_years) AS longest FROM s GROUP BY ALL"""


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: flows by event type as whole units, exact in any order of addition."""
    unit = F.col("value").cast("decimal(18,2)")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, unit)), F.lit(0)).cast("double")
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(of("signup").alias("granted"), of("purchase").alias("exercised"), of("error").alias("lapsed"), of("view").alias("vested"), F.sum(F.when(F.col("event_type") == "click", unit)).cast("double").alias("settled"))


_FLOW_SQL = """
    SELECT user_id, CAST(ts AS DATE) AS day,
           CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'signup'), 0) AS DOUBLE) AS granted,
           CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS exercised,
           CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'error'), 0) AS DOUBLE) AS lapsed,
           CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'view'), 0) AS DOUBLE) AS vested,
           CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS DOUBLE) AS settled
    FROM events GROUP BY user_id, CAST(ts AS DATE)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the running closing balance and the one before it as opening."""
    net = (F.col("granted") - F.col("exercised") - F.col("lapsed")).cast("decimal(18,2)")
    closing = F.sum(net).over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    rows = _flows(spark, sf_dir).withColumn("closing", closing.cast("double"))
    return rows.withColumn("opening", F.coalesce(F.lag("closing").over(Window.partitionBy("user_id").orderBy("day")), F.lit(0.0)))


_LEDGER_SQL = f"""
    SELECT *, coalesce(lag(closing) OVER (PARTITION BY user_id ORDER BY day), 0.0) AS opening FROM (
        SELECT *, CAST(sum(CAST(granted - exercised - lapsed AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS closing FROM ({_FLOW_SQL}))"""


def rollforward_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir)
    gap = plans.rollforward_gap("opening", "granted", "exercised", "lapsed", "closing")
    check = plans.math_check("opening", F.col("granted"), F.col("exercised"), F.col("lapsed"), "closing")
    return rows.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.bround("opening", 2).alias("opening"), F.bround("closing", 2).alias("closing"), F.bround(gap, 2).alias("gap"), plans.rollforward_ok(gap, "closing").alias("ok"), check.alias("check"))


ROLLFORWARD_LEDGER = f"""
WITH l AS ({_LEDGER_SQL})
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(opening, 2) AS opening, round(closing, 2) AS closing, round(abs(opening + granted - exercised - lapsed - closing), 2) AS gap,
       abs(opening + granted - exercised - lapsed - closing) <= greatest(abs(closing) * 0.01, 1.0) AS ok,
       CASE WHEN abs(opening + granted - exercised - lapsed - closing) <= 1 THEN 'ok' ELSE 'check' END AS "check" FROM l"""


def rollforward_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's days as years, the day before as the prior year: closings of some users are off, some flows are negative."""
    days = Window.partitionBy("user_id").orderBy("day")
    rows = _ledger(spark, sf_dir).withColumn("closing", F.col("closing") + 40 * (F.col("user_id") % 3)).withColumn("lapsed", F.when(F.col("user_id") % 11 == 0, -F.col("lapsed")).otherwise(F.col("lapsed")))
    before = {f"prior_{c}": F.lag(c).over(days) for c in ("opening", "granted", "exercised", "lapsed", "closing", "vested")}
    rows = rows.withColumns(before).withColumn("exercisable", F.col("granted") * 2)
    gap = F.bround(plans.rollforward_gap("opening", "granted", "exercised", "lapsed", "closing", "vested", "settled"), 2)
    prior = F.bround(plans.prior_rollforward_gap("prior_opening", "prior_granted", "prior_exercised", "prior_lapsed", "prior_closing", "prior_vested"), 2)
    warned = plans.warnings(
        (~plans.rollforward_ok(gap, "closing"), "rollforward"), (~plans.rollforward_ok(prior, "prior_closing"), "prior rollforward"), (~plans.years_meet("prior_closing", "opening"), "years do not meet"),
        (plans.negative_flow("exercised", "lapsed", "vested"), "negative flow"), (plans.over_exercisable("exercisable", "closing"), "over exercisable"),
    )
    return rows.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), gap.alias("gap"), F.concat_ws("; ", warned).alias("warnings")).where("warnings <> ''")


ROLLFORWARD_MISMATCH = f"""
WITH l AS (SELECT user_id, day, opening, granted, exercised, CASE WHEN user_id % 11 = 0 THEN -lapsed ELSE lapsed END AS lapsed, vested, coalesce(settled, 0.0) AS settled, closing + 40 * (user_id % 3) AS closing FROM ({_LEDGER_SQL})),
b AS (SELECT *, opening + granted - exercised - lapsed AS b FROM l),
g AS (SELECT *, round_even(least(abs(b - closing), abs(b - vested - closing), abs(b - settled - closing), abs(b - vested - settled - closing)), 2) AS gap,
             lag(round_even(least(abs(b - closing), abs(b - vested - closing)), 2)) OVER d AS prior_gap, lag(closing) OVER d AS prior_closing FROM b WINDOW d AS (PARTITION BY user_id ORDER BY day)),
w AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS day, gap, concat_ws('; ', CASE WHEN gap > greatest(abs(closing) * 0.01, 1.0) THEN 'rollforward' END, CASE WHEN prior_gap > greatest(abs(prior_closing) * 0.01, 1.0) THEN 'prior rollforward' END,
             CASE WHEN abs(prior_closing - opening) > greatest(abs(opening) * 0.01, 1.0) THEN 'years do not meet' END, CASE WHEN least(exercised, lapsed, vested) < 0 THEN 'negative flow' END, CASE WHEN granted * 2 > closing THEN 'over exercisable' END) AS warnings FROM g)
SELECT * FROM w WHERE warnings <> ''"""


def _customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), status("F").alias("granted"), status("O").alias("exercised"), status("P").alias("lapsed"))


_CUSTOMER_YEAR_SQL = """
    SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS granted,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS exercised,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS lapsed
    FROM orders GROUP BY o_custkey, year(o_orderdate)"""


def prior_vs_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_years(spark, sf_dir).withColumn("prior", F.lag("total").over(Window.partitionBy("o_custkey").orderBy("year")))
    difference, relative = plans.change(F.col("total"), F.col("prior"))
    rate = lambda c: F.bround(F.try_divide(c, F.col("prior")), 4)
    return rows.select("o_custkey", "year", F.bround(difference, 2).alias("difference"), F.bround(relative, 4).alias("relative"), rate(F.col("granted")).alias("grant_rate"), rate(F.col("exercised")).alias("exercise_rate"), rate(F.col("lapsed")).alias("lapse_rate"))


PRIOR_VS_CURRENT = f"""
WITH c AS (SELECT *, lag(total) OVER (PARTITION BY o_custkey ORDER BY year) AS prior FROM ({_CUSTOMER_YEAR_SQL}))
SELECT o_custkey, year, round_even(total - prior, 2) AS difference, round_even((total - prior) / prior, 4) AS relative, round_even(granted / prior, 4) AS grant_rate, round_even(exercised / prior, 4) AS exercise_rate, round_even(lapsed / prior, 4) AS lapse_rate FROM c"""


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness counters and warning lists per flag and status of the plans."""
    rows = _plans(spark, sf_dir)
    has = lambda c: F.count_if(F.col(c).isNotNull())
    counters = rows.groupBy("units_label").agg(F.count(F.lit(1)).alias("plans"), has("is_nil_cost").alias("with_type"), has("weighted_avg_remaining_contractual_life_years").alias("with_life"), has("vesting_period_years").alias("with_vesting"), F.count_if(F.col("closing_balance") > 25).alias("large"))
    warned = plans.warnings((F.col("with_type") < F.col("plans"), "type missing"), (F.col("with_life") < F.col("plans"), "life missing"), (F.col("units_label").isNull(), "units missing"))
    return counters.withColumn("warnings", F.concat_ws("; ", warned))


VALIDATION_SUMMARY = f"""
WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 'thousands' WHEN 'R' THEN 'millions' END AS units_label, CASE WHEN l_linestatus = 'O' THEN TRUE WHEN l_discount > 0.05 THEN FALSE END AS nil,
                  NULLIF(l_tax, 0) AS life, NULLIF(l_discount, 0) AS vest, l_quantity FROM lineitem),
c AS (SELECT units_label, count(*) AS plans, count(nil) AS with_type, count(life) AS with_life, count(vest) AS with_vesting, count(*) FILTER (l_quantity > 25) AS large FROM p GROUP BY units_label)
SELECT *, concat_ws('; ', CASE WHEN with_type < plans THEN 'type missing' END, CASE WHEN with_life < plans THEN 'life missing' END, CASE WHEN units_label IS NULL THEN 'units missing' END) AS warnings FROM c"""


def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extraction batches of a customer: for each field the first filled value in batch order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("final_price"), F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("urgent_date"), F.col("o_orderstatus").alias("status"))
    return plans.first_filled(orders, ["o_custkey"], "o_orderkey", ["final_price", "urgent_date", "status"])


BATCH_MERGE = """
SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS final_price, arg_min(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS urgent_date,
       arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey"""


def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extraction batches of a customer, their lines as plans: plans of one name and type are one, with inputs field by field and tranches by month."""
    n = F.col("l_linenumber")
    plan = F.struct(
        F.when(n % 2 == 0, F.lower("l_returnflag")).otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("plan_name"), F.col("l_linestatus").alias("plan_type"), F.when(n % 3 == 0, F.col("l_quantity")).alias("closing"),
        F.struct(F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("rate"), F.when(n > 3, F.struct(F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"))).alias("more")).alias("inputs"),
        F.create_map(F.lit("line"), n.cast("long"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")), F.col("l_partkey").cast("long")).alias("notes"),
        F.array(F.struct(F.when(n % 4 > 0, F.date_format("l_shipdate", "yyyy-MM")).alias("month"), F.col("l_quantity").cast("long").alias("shares"))).alias("tranches"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(merge.in_order(F.collect_list(F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"), plan.alias("r")))).alias("plans"))
    batches = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("standard")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    keyed = {"plans": merge.Keyed("plan_name", "plan_type", merge=True), "plans[].tranches": merge.Keyed("month", merge=False)}
    whole = merge.merge_records(batches, ["o_custkey"], ["o_orderkey"], keyed)
    each = whole.select("o_custkey", "standard", F.posexplode("plans").alias("pos", "p"))
    shares = F.aggregate("p.tranches", F.lit(0).cast("long"), lambda a, t: a + t["shares"])
    return each.select("o_custkey", "standard", F.col("pos").cast("long").alias("pos"), "p.plan_name", "p.plan_type", "p.closing", "p.inputs.rate", "p.inputs.more.tax", F.size("p.tranches").cast("long").alias("tranches"), shares.alias("shares"), F.col("p.notes")["line"].alias("line"), F.col("p.notes")["s1"].alias("s1"))


DEEP_MERGE = """
WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_linenumber AS n, l_returnflag AS f, lower(l_returnflag) AS k, l_linestatus AS t, l_quantity AS q, l_discount AS d, l_tax AS x, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 > 0 THEN strftime(l_shipdate, '%Y-%m') END AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k, t, m ORDER BY i) AS seen FROM l),
a AS (SELECT o_custkey, k, t, min(i) AS i, arg_min(CASE WHEN n % 2 = 0 THEN k ELSE ' ' || f END, i) AS plan_name, arg_min(q, i) FILTER (n % 3 = 0) AS closing, arg_min(d, i) FILTER (d > 0.05) AS rate, arg_min(x, i) FILTER (n > 3 AND x > 0.04) AS tax,
      count(*) FILTER (m IS NULL OR seen = 1) AS tranches, CAST(sum(q) FILTER (m IS NULL OR seen = 1) AS BIGINT) AS shares, arg_min(n, i) AS line, arg_min(l_partkey, i) FILTER (l_suppkey % 3 = 1) AS s1 FROM s GROUP BY ALL),
h AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS standard FROM orders GROUP BY o_custkey)
SELECT o_custkey, standard, row_number() OVER (PARTITION BY o_custkey ORDER BY i) - 1 AS pos, plan_name, t AS plan_type, closing, rate, tax, tranches, shares, line, s1 FROM a JOIN h USING (o_custkey)"""


def report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's columns that hold anything: one that no order fills is left out, the key stays."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("refund"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("final"), F.lit(None).cast("string").alias("note"))
    return plans.filled_columns(rows, ["o_orderkey"])


REPORT_COLUMNS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS final FROM orders"


def tranche_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as batches: tranches of the first batch, and later ones of a ship date not seen before."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 5, F.date_format("l_shipdate", "yyyy-MM")).alias("grant_month"), F.col("l_quantity").cast("long").alias("shares"))
    merged = plans.merge_tranches(rows, ["l_orderkey"], "l_linenumber", "grant_month")
    return merged.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tranches"), F.count("grant_month").alias("dated"), F.sum("shares").alias("shares"))


TRANCHE_MERGE = """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN strftime(l_shipdate, '%Y-%m') END AS m, CAST(l_quantity AS BIGINT) AS shares FROM lineitem),
s AS (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, m) AS seen FROM t)
SELECT l_orderkey, count(*) AS tranches, count(m) AS dated, CAST(sum(shares) AS BIGINT) AS shares FROM s WHERE m IS NULL OR l_linenumber = seen GROUP BY l_orderkey"""


def tranche_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select("p_brand", F.col("l_quantity").cast("decimal(10,0)").alias("shares"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    out = plans.tranche_subtotals(rows, ["p_brand"], "shares", "price")
    return out.select("p_brand", "n", F.col("shares").cast("double").alias("shares"), F.col("min_price").cast("double").alias("min_price"), F.col("max_price").cast("double").alias("max_price"), F.bround(F.col("avg_price").cast("double"), 3).alias("avg_price"))


TRANCHE_SUBTOTALS = """
SELECT p_brand, count(*) AS n, sum(l_quantity) AS shares, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
       round_even(CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity), 3) AS avg_price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand)"""


def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by segment with a TOTAL row and each one's share of it."""
    amount = F.coalesce(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), F.lit(0)).cast("double")
    rows = table(spark, sf_dir, "customer").rollup("c_mktsegment").agg(amount.alias("amount"), F.count(F.lit(1)).alias("n"), F.grouping("c_mktsegment").alias("g"))
    whole = F.max(F.when(F.col("g") == 1, F.col("amount"))).over(Window.partitionBy())
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("c_mktsegment")).alias("segment"), "n", "amount", F.bround(F.try_divide("amount", whole), 6).alias("share"))


SHARE_OF_TOTAL = """
WITH s AS (SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM customer GROUP BY c_mktsegment), t AS (SELECT sum(n) AS n, (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer) AS amount FROM s)
SELECT s.c_mktsegment AS segment, s.n, s.amount, round_even(s.amount / t.amount, 6) AS share FROM s, t
UNION ALL SELECT 'TOTAL', CAST(n AS BIGINT), amount, 1.0 FROM t"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: total, the largest customer and its share, how many are nil, the sorted list of segments."""
    rows = table(spark, sf_dir, "customer")
    total = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
    return rows.groupBy("c_nationkey").agg(total.alias("total"), F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("largest"), F.bround(F.max("c_acctbal") / total, 6).alias("largest_share"), F.count_if(F.col("c_acctbal") < 1000).alias("small"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ", ").alias("segments"))


INSIGHTS = """
SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, arg_max(c_name, (c_acctbal, c_custkey)) AS largest, round_even(max(c_acctbal) / CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 6) AS largest_share,
       count(*) FILTER (c_acctbal < 1000) AS small, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey"""


def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    checks = {"has_value": F.col("value") > 0, "large": F.col("value") > 50, "even_user": F.col("user_id") % 2 == 0, "never": F.col("value") < 0}
    return plans.completeness(rows, "event_type", checks, ["view", "click", "signup", "purchase", "error"])


COMPLETENESS_MATRIX = """
WITH c AS (SELECT event_type, unnest(['has_value', 'large', 'even_user', 'never']) AS "check", unnest([value > 0, value > 50, user_id % 2 = 0, value < 0]) AS ok FROM events)
SELECT "check", count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase,
       count(*) FILTER (event_type = 'error') AS error FROM c WHERE ok GROUP BY "check" """


def param_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation parameters down, flags across: one representative plan (largest price) per flag."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.max_by(F.struct("l_quantity", "l_discount", "l_tax", F.lit(None).cast("double").alias("l_none")), F.struct("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).alias("b")).select("l_returnflag", "b.*")
    return plans.parameter_matrix(best, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_none"], ["A", "N", "R"])


PARAM_MATRIX = """
WITH b AS (SELECT l_returnflag AS f, arg_max({'q': l_quantity, 'd': l_discount, 't': l_tax}, (l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS b FROM lineitem GROUP BY l_returnflag),
u AS (SELECT f, unnest(['l_quantity', 'l_discount', 'l_tax']) AS parameter, unnest([b.q, b.d, b.t]) AS value FROM b)
SELECT parameter, max(value) FILTER (f = 'A') AS "A", max(value) FILTER (f = 'N') AS "N", max(value) FILTER (f = 'R') AS "R" FROM u GROUP BY parameter"""


def units_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.concat(F.lit(" "), F.col("l_returnflag"))).alias("label"))
    return plans.units_consensus(rows, ["l_orderkey"], "label")


UNITS_CONSENSUS = """
WITH u AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS label FROM lineitem)
SELECT l_orderkey, CASE count(DISTINCT label) WHEN 0 THEN 'absolute' WHEN 1 THEN max(label) ELSE 'mixed' END AS units FROM u GROUP BY l_orderkey"""


def currency_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent event type of each user; ties go to the one seen first."""
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return counted.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


CURRENCY_MODE = """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c)
SELECT user_id, event_type AS mode, n FROM r WHERE k = 1"""


def period_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as durations of 90 or 365 days up to the order date; the report date is the last one."""
    orders = table(spark, sf_dir, "orders").withColumn("period_end", F.to_date("o_orderdate"))
    spans = orders.withColumn("report", F.max("period_end").over(Window.partitionBy("o_custkey"))).withColumn("period_start", F.date_sub("period_end", F.when(F.col("o_orderstatus") == "F", 365).otherwise(90)))
    chosen = facts.period_choice(spans, ["o_custkey"], "report")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return chosen.select("o_custkey", day("cur_start"), day("cur_end"), F.col("cur_days").cast("long").alias("cur_days"), day("pri_start"), day("pri_end"))


PERIOD_CHOICE = """
WITH s AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS e, CAST(o_orderdate AS DATE) - CASE o_orderstatus WHEN 'F' THEN 365 ELSE 90 END AS b, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS report FROM orders),
c AS (SELECT o_custkey, arg_max({'b': b, 'e': e, 'n': e - b}, (e - b, e)) AS c FROM s WHERE report - e <= 15 GROUP BY o_custkey),
p AS (SELECT o_custkey, arg_min({'b': s.b, 'e': s.e}, (abs(s.e - c.c.b), s.b)) AS p FROM s JOIN c USING (o_custkey)
      WHERE abs(s.e - c.c.b) <= 15 AND abs((s.e - s.b) - c.c.n) <= greatest(30, c.c.n // 5) GROUP BY o_custkey)
SELECT o_custkey, strftime(c.c.b, '%Y-%m-%d') AS cur_start, strftime(c.c.e, '%Y-%m-%d') AS cur_end, c.c.n AS cur_days, strftime(p.p.b, '%Y-%m-%d') AS pri_start, strftime(p.p.e, '%Y-%m-%d') AS pri_end FROM c LEFT JOIN p USING (o_custkey)"""


def fact_slotting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as instants against each customer's last year of orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("period_instant"))
    last = F.max("period_instant").over(Window.partitionBy("o_custkey"))
    none = F.lit(None).cast("date")
    rows = orders.withColumn("cur_end", last).withColumns({"cur_start": F.date_sub("cur_end", 365), "pri_start": F.date_sub("cur_end", 730), "pri_end": F.date_sub("cur_end", 365), "period_start": none, "period_end": none})
    return rows.withColumn("slot", facts.slot()).where("slot is not null").select("o_custkey", "o_orderkey", "slot")


FACT_SLOTTING = """
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS e FROM orders),
s AS (SELECT o_custkey, o_orderkey, CASE WHEN abs(d - e) <= 7 THEN 'closing' WHEN abs(d - (e - 365)) <= 10 THEN 'opening' WHEN abs(d - (e - 730)) <= 10 THEN 'prior_opening' END AS slot FROM o)
SELECT * FROM s WHERE slot IS NOT NULL"""


def fact_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return facts.first_value(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_partkey", "l_extendedprice")


FACT_FIRST_VALUE = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey, l_returnflag, l_partkey, l_extendedprice FROM r WHERE k = 1"""


def unanimous_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort values (status O) that all agree are promoted where an order has no clean value (status F)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_linestatus")
    clean = rows.where("l_linestatus = 'F'").select("l_orderkey").distinct()
    cohort = rows.where("l_linestatus = 'O'").drop("l_linestatus")
    kept = facts.unanimous(cohort, ["l_orderkey"], "l_discount", ["l_linenumber", "l_partkey", "l_suppkey"]).join(clean, "l_orderkey", "left_anti")
    return kept.select("l_orderkey", "l_discount", "l_partkey")


UNANIMOUS_PROMOTION = """
SELECT l_orderkey, max(l_discount) AS l_discount, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem
GROUP BY l_orderkey HAVING count(*) FILTER (l_linestatus = 'F') = 0 AND count(DISTINCT l_discount) = 1"""


def detail_merge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers attach to the largest customer of their nation and trade, else of their region, else overall; every seventh has no region."""
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    trade = F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "NONE")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.struct(F.col("s_nationkey").alias("n"), trade.alias("t")).alias("k1"), F.when(F.col("s_suppkey") % 7 > 0, F.col("n_regionkey")).alias("k2"))
    largest = F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey"))
    by = lambda key, i: customers.groupBy(key.alias(f"k{i}")).agg(largest.alias(f"t{i}"))
    overall = customers.agg(largest).first()[0]  # one number
    out = suppliers.join(by(F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("t")), 1), "k1", "left").join(by(F.col("n_regionkey"), 2), "k2", "left")
    level = F.when(F.col("t1").isNotNull(), "nation").when(F.col("t2").isNotNull(), "region").otherwise("all")
    return out.select("s_suppkey", F.coalesce("t1", "t2", F.lit(overall)).alias("target"), level.alias("level"))


DETAIL_MERGE_CASCADE = """
WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT c_nationkey, c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS t FROM c GROUP BY ALL), b AS (SELECT n_regionkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS t FROM c GROUP BY ALL),
d AS (SELECT arg_max(c_custkey, (c_acctbal, c_custkey)) AS t FROM c),
s AS (SELECT s_suppkey, s_nationkey, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD', 'NONE'][s_suppkey % 6 + 1] AS trade, CASE WHEN s_suppkey % 7 > 0 THEN n_regionkey END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, coalesce(a.t, b.t, d.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'nation' WHEN b.t IS NOT NULL THEN 'region' ELSE 'all' END AS level
FROM s LEFT JOIN a ON a.c_nationkey = s_nationkey AND a.c_mktsegment = trade LEFT JOIN b ON b.n_regionkey = region CROSS JOIN d"""


def dimensional_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings whose facts have award and plan axes: details without a plan and shared inputs find their bucket, a fact with an axis too many is left out."""
    lines = table(spark, sf_dir, "lineitem")
    own = dealt(lines.select(F.col("l_orderkey").cast("string").alias("filing"), "l_orderkey", "l_quantity", "l_extendedprice"), lines, "filing")
    sums = own.groupBy("filing", "l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.count(F.lit(1)).alias("n"))
    award, plan = F.lit("us-gaap:AwardTypeAxis"), F.lit("us-gaap:PlanNameAxis")
    units, options = F.lit("us-gaap:RestrictedStockUnitsRSUMember"), F.lit("us-gaap:EmployeeStockOptionMember")
    prefix, day = "us-gaap:ShareBasedCompensationArrangementByShareBasedPaymentAward", lambda s: F.lit(s).cast("date")
    of_units, years = F.create_map(award, units), (1 + F.col("l_orderkey") % 4).cast("string")
    rows = [  # concept, text, number, at an instant, axes
        ("EquityInstrumentsOtherThanOptionsNonvestedNumber", None, F.lit(9e9), True, F.create_map(award, units, plan, F.lit("x:PlanMember"), F.lit("srt:RangeAxis"), F.lit("srt:MaximumMember"))),
        ("EquityInstrumentsOtherThanOptionsNonvestedNumber", None, F.col("q") * 1000, True, F.create_map(award, units, plan, F.lit("x:PlanMember"))),
        ("EquityInstrumentsOtherThanOptionsNonvestedWeightedAverageGrantDateFairValue", None, F.col("high"), True, of_units),
        ("AwardVestingPeriod1", F.concat(F.lit("P"), years, F.lit("Y")), F.lit(None).cast("double"), False, of_units),
        ("OptionsOutstandingNumber", None, F.col("n") * 10_000.0, True, F.create_map(award, options)),
        ("OptionsOutstandingWeightedAverageExercisePrice", None, F.col("low"), True, F.create_map(award, options)),
        ("OptionsOutstandingWeightedAverageRemainingContractualTerm1", F.lit("P5Y6M"), F.lit(None).cast("double"), False, F.create_map().cast("map<string,string>")),
    ]
    entry = lambda i, c, t, v, instant, dims: F.struct(F.lit(i).cast("long").alias("pos"), F.lit(prefix + c).alias("concept"), F.coalesce(t, v.cast("string")).alias("value") if t is not None else v.cast("string").alias("value"), v.cast("double").alias("numeric_value"), F.lit("shares").alias("unit_ref"), (F.lit(None).cast("date") if instant else day("2025-01-01")).alias("period_start"), (F.lit(None).cast("date") if instant else day("2025-12-31")).alias("period_end"), (day("2025-12-31") if instant else F.lit(None).cast("date")).alias("period_instant"), dims.alias("dims"))
    tagged = sums.select("filing", F.explode(F.array(*[entry(i, *row) for i, row in enumerate(rows)])).alias("f")).select("filing", "f.*")
    filings = sums.select("filing", day("2025-12-31").alias("period_of_report"))
    out = facts.plan_rows_of(tagged, filings)
    return out.select("filing", "kind", F.col("rank").cast("long").alias("rank"), F.bround("count_mn", 6).alias("count_mn"), "strike", "maturity_years")


DIMENSIONAL_FACTS = """
WITH s AS (SELECT l_orderkey AS k, sum(l_quantity) * 1000 / 1e6 AS u, max(l_extendedprice) AS high, min(l_extendedprice) AS low, count(*) * 10000.0 / 1e6 AS o FROM lineitem GROUP BY l_orderkey),
r AS (SELECT k, 'rsu' AS kind, u AS c, high AS strike, 1.0 + k % 4 AS maturity_years FROM s UNION ALL SELECT k, 'option', o, low, 5.5 FROM s)
SELECT CAST(k AS VARCHAR) AS filing, kind, row_number() OVER (PARTITION BY k ORDER BY c DESC, kind) AS rank, round_even(CAST(c AS DOUBLE), 6) AS count_mn, strike, CAST(maturity_years AS DOUBLE) AS maturity_years FROM r"""


def facts_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from tagged facts to strict rows: each order is a filing, each line item a tagged fact."""
    lines, filing = table(spark, sf_dir, "lineitem"), F.col("l_orderkey").cast("string").alias("filing")
    items = dealt(lines.select(filing, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag"), lines, "filing")
    prefix = "us-gaap:ShareBasedCompensationArrangementByShareBasedPaymentAward"
    concept = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), prefix + "OptionsOutstandingWeightedAverageExercisePrice").when(F.col("l_linestatus") == "O", prefix + "OptionsOutstandingNumber").when(F.col("l_returnflag") == "A", prefix + "EquityInstrumentsOtherThanOptionsNonvestedWeightedAverageGrantDateFairValue").otherwise(prefix + "EquityInstrumentsOtherThanOptionsNonvestedNumber")
    amount = F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(F.col("l_quantity") * 1000)
    day = lambda s: F.lit(s).cast("date")
    facts_ = items.select("filing", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") % 10_000).alias("pos"), concept.alias("concept"), amount.cast("string").alias("value"), amount.alias("numeric_value"), F.lit("shares").alias("unit_ref"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"), day("2025-12-31").alias("period_instant"), F.lit(None).cast("map<string,string>").alias("dims"))
    filings = items.select("filing").distinct().withColumn("period_of_report", day("2025-12-31"))
    span = filings.select("filing", F.lit(-1).cast("long").alias("pos"), F.lit("dei:DocumentType").alias("concept"), F.lit("x").alias("value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(None).cast("string").alias("unit_ref"), day("2025-01-01").alias("period_start"), day("2025-12-31").alias("period_end"), F.lit(None).cast("date").alias("period_instant"), F.lit(None).cast("map<string,string>").alias("dims"))
    rows = facts.plan_rows_of(facts_.unionByName(span), filings)
    return rows.select("filing", "kind", F.col("rank").cast("long").alias("rank"), F.bround("count_mn", 6).alias("count_mn"), "strike")


FACTS_TO_ROWS = """
WITH f AS (SELECT l_orderkey, l_linestatus AS s, l_returnflag = 'A' AS price, arg_min(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE l_quantity * 1000 END, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000) AS v FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey, s, max(v) FILTER (NOT price) AS n, max(v) FILTER (price) AS p FROM f GROUP BY ALL HAVING max(v) FILTER (NOT price) > 0),
o AS (SELECT CAST(l_orderkey AS VARCHAR) AS filing, CASE s WHEN 'O' THEN 'option' ELSE 'rsu' END AS kind, round(n / 1e6, 6) AS count_mn, p AS strike FROM k)
SELECT filing, kind, row_number() OVER (PARTITION BY filing ORDER BY count_mn DESC, kind) AS rank, count_mn, strike FROM o"""
