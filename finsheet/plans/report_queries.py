"""The seven report tables and the printed-page readers over the driver tables: line items are plans of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.functions import statement
from finsheet.operators import facts, report, sheet
from finsheet.plans.tables import dealt, table


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q, k = F.col("l_linenumber"), F.floor("l_quantity").cast("double"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(k % 7 != 0, F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), n.cast("string"), q.cast("int").cast("string"))).alias("plan_name"), F.when(k % 3 != 0, F.lit("LTIP")).alias("plan_type"),
        (F.col("l_returnflag") == "A").alias("is_nil_cost"), F.when(k % 4 != 0, k % 4 == 1).alias("is_cash_settled"), (q * 10).alias("opening"), F.when(k % 5 != 0, q).alias("granted"), (q * 2).alias("exercised"), F.when(k % 2 == 0, q).alias("lapsed"),
        F.when(k % 6 != 0, q * 9 - F.when(k % 2 == 0, q).otherwise(0)).alias("closing"), F.when(k % 8 == 0, F.col("l_discount")).alias("volatility"), F.when(k % 8 == 1, F.col("l_tax")).alias("risk_free_rate"), F.lit(None).cast("double").alias("expected_term"),
        F.when(k % 9 == 0, q).alias("option_value"), F.when(k % 9 == 1, q + 1).alias("grant_date_value"), F.when(k % 10 == 0, F.lit("Plan text.")).alias("description"), F.when(k % 11 == 0, F.lit("over time")).alias("vesting"),
        F.when(k % 2 == 0, (k % 5).cast("int")).alias("vesting_years"), F.when(k % 13 == 0, F.lit("growth")).alias("conditions"), F.when(k % 17 == 0, F.lit(3)).alias("performance_years"), F.lit(None).cast("int").alias("holding_years"), F.when(k % 19 == 0, F.lit(150)).alias("payout"),
    )


_PLANS = """
    SELECT l_orderkey, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(q AS INTEGER) END AS plan_name, CASE WHEN l_partkey % 3 <> 0 THEN 'LTIP' END AS plan_type, l_returnflag = 'A' AS nil, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 4 = 1 END AS cash,
           q * 10 AS opening, CASE WHEN l_partkey % 5 <> 0 THEN q END AS granted, q * 2 AS exercised, CASE WHEN l_partkey % 2 = 0 THEN q END AS lapsed, CASE WHEN l_partkey % 6 <> 0 THEN q * 9 - CASE WHEN l_partkey % 2 = 0 THEN q ELSE 0 END END AS closing,
           CASE WHEN l_partkey % 8 = 0 THEN l_discount END AS volatility, CASE WHEN l_partkey % 8 = 1 THEN l_tax END AS risk_free_rate, CASE WHEN l_partkey % 9 = 0 THEN q WHEN l_partkey % 9 = 1 THEN q + 1 END AS fair_value, l_partkey AS k
    FROM (SELECT *, floor(l_quantity) AS q FROM lineitem)"""


def _tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in order; two flags are the plans."""
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 51 + F.col("l_quantity").cast("long")
    lines = table(spark, sf_dir, "lineitem")
    own = dealt(lines.select("l_orderkey", pos.alias("pos"), "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice"), lines, "l_orderkey")
    return own.groupBy("l_orderkey", "pos").agg(F.min("l_returnflag").alias("plan_name"), F.min("l_shipdate").alias("grant_date"), F.max("l_quantity").alias("outstanding"), F.max("l_extendedprice").alias("price"))


def _report(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return report.reports(_plans(spark, sf_dir), _tranches(spark, sf_dir), ["l_orderkey"])


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["summary"]


REPORT_SUMMARY = f"""
SELECT l_orderkey, count(*) AS plans, coalesce(sum(opening), 0) AS total_opening, coalesce(sum(granted), 0) AS total_granted, coalesce(sum(exercised), 0) AS total_exercised, coalesce(sum(lapsed), 0) AS total_lapsed, coalesce(sum(closing), 0) AS total_closing,
       count(*) FILTER (nil) AS nil_cost_plans FROM ({_PLANS}) GROUP BY l_orderkey"""


def report_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["rollforward"]


REPORT_ROLLFORWARD = f"""
WITH g AS (SELECT *, abs(opening + coalesce(granted, 0) - exercised - coalesce(lapsed, 0) - closing) AS gap FROM ({_PLANS}))
SELECT l_orderkey, plan_name, opening, granted, exercised, lapsed, closing, round_even(gap, 2) AS gap, CASE WHEN gap IS NULL THEN 'n/a' WHEN gap <= 1 THEN 'ok' ELSE 'check' END AS "check" FROM g"""


def report_tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir)["tranches"]
    return rows.select("l_orderkey", "plan_name", "pos", "outstanding", "price", F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"))


REPORT_TRANCHES = """
WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey * 51 + CAST(l_quantity AS BIGINT) AS pos, min(l_returnflag) AS plan_name, max(l_quantity) AS outstanding, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS i, row_number() OVER (PARTITION BY l_orderkey, plan_name ORDER BY pos) AS j FROM t),
s AS (SELECT l_orderkey, plan_name, i - j AS run, min(i) AS first_row, max(i) AS last_row FROM r GROUP BY ALL),
l AS (SELECT l_orderkey, plan_name, max(first_row) AS first_row, arg_max(last_row, first_row) AS last_row FROM s GROUP BY ALL)
SELECT l_orderkey, plan_name, pos, outstanding, price, first_row, last_row FROM t JOIN l USING (l_orderkey, plan_name)"""


def report_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["valuation"].drop("expected_term")


REPORT_VALUATION = f"""
SELECT l_orderkey, plan_name, fair_value, volatility, risk_free_rate FROM ({_PLANS}) WHERE coalesce(fair_value, volatility, risk_free_rate) IS NOT NULL"""


def report_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["descriptions"]


REPORT_DESCRIPTIONS = f"""
WITH d AS (SELECT *, concat_ws(' ', CASE WHEN k % 10 = 0 THEN 'Plan text.' END, CASE WHEN k % 11 = 0 THEN 'Vesting: over time.' END, CASE WHEN k % 2 = 0 AND k % 11 <> 0 THEN 'Vesting period: ' || k % 5 || ' years.' END,
                  CASE WHEN k % 13 = 0 THEN 'Performance conditions: growth.' END, CASE WHEN k % 17 = 0 THEN 'Performance period: 3 years.' END, CASE WHEN k % 19 = 0 THEN 'Maximum payout: 150% of baseline.' END) AS t,
                  concat_ws(', ', CASE WHEN nil THEN 'Nil-cost' END, CASE WHEN cash THEN 'Cash-settled' WHEN NOT cash THEN 'Equity-settled' END) AS x FROM ({_PLANS}) WHERE plan_name IS NOT NULL OR k % 10 = 0)
SELECT l_orderkey, coalesce(plan_name, '—') AS plan_name, coalesce(plan_type, '—') || CASE WHEN x = '' THEN '' ELSE ' (' || x || ')' END AS plan_type, CASE WHEN t = '' THEN 'No description disclosed.' ELSE t END AS text FROM d"""


def report_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["figures"]


REPORT_FIGURES = f"""
SELECT l_orderkey, round_even(sum(granted) / nullif(sum(opening), 0), 6) AS grant_rate, round_even(sum(exercised) / nullif(sum(opening), 0), 6) AS exercise_rate, round_even(sum(lapsed) / nullif(sum(opening), 0), 6) AS lapse_rate,
       round_even((sum(closing) - sum(opening)) / nullif(sum(opening), 0), 6) AS change FROM ({_PLANS}) GROUP BY l_orderkey"""


def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)["quality"].drop("with_expected_term")


REPORT_QUALITY = f"""
SELECT l_orderkey, count(*) AS plans, count(opening) AS with_opening, count(granted) AS with_granted, count(exercised) AS with_exercised, count(lapsed) AS with_lapsed, count(closing) AS with_closing, count(volatility) AS with_volatility,
       count(risk_free_rate) AS with_risk_free_rate, count(*) FILTER (abs(opening + coalesce(granted, 0) - exercised - coalesce(lapsed, 0) - closing) > greatest(abs(closing) * 0.01, 1.0)) AS rollforward_mismatches FROM ({_PLANS}) GROUP BY l_orderkey"""


def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page prints its oldest column first: years in prose, then in a header row, from each order's key."""
    k = F.col("o_orderkey")
    year = lambda turn: F.concat(F.lit("20"), F.lpad(((k * turn + turn) % 12).cast("string"), 2, "0"))
    gap = F.element_at(F.array(F.lit(" and "), F.lit("\n"), F.lit("  "), F.lit(", the year that comes a long while before or after ")), (k % 4 + 1).cast("int"))
    header = F.element_at(F.array(F.lit("\n"), F.lit(" | "), F.lit(" ")), (k % 3 + 1).cast("int"))
    text = F.concat(F.lit("As of "), year(1), gap, year(5), F.lit(" the company says in its report of the year and nothing else here\n"), year(7), header, year(3), F.lit("\n"))
    return table(spark, sf_dir, "orders").select("o_orderkey", statement.columns_oldest_first(text).alias("oldest_first"))


COLUMN_ORDER = """
WITH y AS (SELECT o_orderkey, 2000 + (o_orderkey + 1) % 12 AS a, 2000 + (o_orderkey * 5 + 5) % 12 AS b, 2000 + (o_orderkey * 7 + 7) % 12 AS c, 2000 + (o_orderkey * 3 + 3) % 12 AS d, o_orderkey % 4 AS g, o_orderkey % 3 AS h FROM orders),
q AS (SELECT *, a <> b AND abs(a - b) <= 4 AS p1, c <> d AND abs(c - d) <= 4 AS p2 FROM y)
SELECT o_orderkey, CASE WHEN p1 AND g IN (1, 2) THEN a < b WHEN p2 AND h IN (0, 2) THEN c < d WHEN p1 AND g = 0 THEN a < b WHEN p2 THEN c < d ELSE FALSE END AS oldest_first FROM q"""


def printed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the first row with a label, on its line or the next ones, and the sums of two rows column by column."""
    k = F.col("o_orderkey")
    amount = F.format_number(F.floor(F.col("o_totalprice")), 0)
    note = F.when(k % 2 == 0, F.lit("6.1\n")).otherwise(F.lit(""))
    first = F.when(k % 3 == 0, F.concat(F.lit("total equity "), amount, F.lit("\n"))).when(k % 3 == 1, F.concat(F.lit("total equity\n"), note, amount, F.lit("\n(12)\n"))).otherwise(F.concat(F.lit("total equity and more words\n"), amount, F.lit("\n")))
    text = F.concat(F.lit("assets\n"), first, F.lit("total non-current liabilities\n100\n200\n300\ntotal current liabilities\n"), F.floor(F.col("o_totalprice") % 100).cast("string"), F.lit("\n7\nend of page"))
    equity = statement.row_values(text, ("total equity",), ("total equity and liabilities",))
    sums = sheet.pairwise_sums(statement.row_values(text, ("total non-current liabilities",)), statement.row_values(text, ("total current liabilities",)))
    candidates = sheet.equity_candidates(F.when(k % 5 == 0, F.floor("o_totalprice").cast("double")), equity, F.array(F.lit(5.0), F.lit(12.0)))
    show = lambda a: F.array_join(F.transform(a, lambda v: v.cast("long").cast("string")), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", show(equity).alias("equity"), show(sums).alias("sums"), show(candidates).alias("candidates"))


PRINTED_ROWS = """
WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(floor(o_totalprice % 100) AS BIGINT) AS c FROM orders),
e AS (SELECT *, CASE WHEN k % 3 = 0 THEN [p] WHEN k % 3 = 1 THEN [p, -12] ELSE CAST([] AS BIGINT[]) END AS equity, CASE WHEN k % 5 = 0 THEN [p] ELSE CAST([] AS BIGINT[]) END AS printed FROM o),
a AS (SELECT *, list_concat(list_concat(printed, equity), [CAST(12 AS BIGINT), 5, 17]) AS every FROM e)
SELECT k AS o_orderkey, array_to_string(equity, ',') AS equity, (100 + c) || ',207' AS sums, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ',') AS candidates FROM a"""


def note_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets in reading order, the size of their flow, and whether a text block is the plan table."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    rows = rows.select("l_orderkey", F.when(F.col("l_linestatus") == "O", "option").otherwise("rsu").alias("family"), F.col("l_returnflag").alias("award"), F.lit("").alias("plan"), F.when(F.col("l_returnflag") == "R", -F.col("q")).otherwise(F.col("q")).alias("flow"))
    block = F.concat(F.lit("Equity  Compensation\nPlan "), F.when(F.col("award") == "A", "Information").otherwise("Note"))
    ordered = facts.families_first(rows, ["l_orderkey"])
    return ordered.select("l_orderkey", "family", "award", F.col("turn").cast("long").alias("turn"), facts.flow_size("flow").alias("flow"), facts.is_plan_information(block).alias("skipped"))


NOTE_FILTERS = """
WITH r AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'option' ELSE 'rsu' END AS family, l_returnflag AS award, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS flow FROM lineitem GROUP BY ALL)
SELECT l_orderkey, family, award, row_number() OVER (PARTITION BY l_orderkey ORDER BY family <> 'option', award) AS turn, flow, award = 'A' AS skipped FROM r"""
