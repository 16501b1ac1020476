"""Balance-sheet and forecast queries over the driver tables: customers are line items of their nation's sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsheet.functions.coerce import half_even
from finsheet.operators import forecast, margin, sheet
from finsheet.plans.tables import table

_CENTS = "decimal(18,2)"


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, side, bucket, amount): segments are buckets, one of them for the rest; positive balances are assets."""
    side = F.when(F.col("c_acctbal") >= 0, "assets").otherwise("liabilities")
    bucket = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("other_"), side)).otherwise(F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", side.alias("side"), bucket.alias("bucket"), F.abs("c_acctbal").cast(_CENTS).alias("amount"))
    return rows.groupBy("c_nationkey", "side", "bucket").agg(F.sum("amount").cast("double").alias("amount"))


_BUCKET_SQL = """
    SELECT c_nationkey, side, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'other_' || side ELSE lower(c_mktsegment) END AS bucket, CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN 'assets' ELSE 'liabilities' END AS side FROM customer) GROUP BY ALL"""


def _contra_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as printed lines of their nation; every second one is tagged with a side."""
    label = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("[ASSET] "), "s_name", F.lit(" (current)"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), label.alias("label"), F.col("s_acctbal").alias("value"))


def _printed(buckets: DataFrame, lines: DataFrame) -> DataFrame:
    """Totals as printed, by nation: a bucket counted twice, a shortfall, a negative line left out, the rest counted twice, or in order."""
    sums = buckets.groupBy("c_nationkey", "side").agg(F.sum(F.col("amount").cast(_CENTS)).cast("double").alias("s"), F.max(F.when(~F.col("bucket").startswith("other_"), F.col("amount"))).alias("m"), F.max(F.when(F.col("bucket").startswith("other_"), F.col("amount"))).alias("o"))
    low = lines.groupBy("c_nationkey").agg(F.min("value").alias("low"))
    turn = F.col("c_nationkey") % 5
    total = F.when(turn == 0, F.col("s") - F.coalesce("m", F.lit(0.0))).when(turn == 1, F.col("s") * 1.05).when(turn == 2, F.col("s") + F.least(F.lit(0.0), F.coalesce("low", F.lit(0.0)))).when(turn == 3, F.col("s") - F.coalesce("o", F.lit(0.0))).otherwise(F.col("s"))
    return sums.join(low, "c_nationkey", "left").select("c_nationkey", "side", half_even(total, 2).alias("total"))


_LINES_SQL = """
    SELECT s_nationkey AS c_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ASSET' ELSE '' END AS tag, s_name AS core, s_acctbal AS value FROM supplier"""
_PRINTED_SQL = f"""
    SELECT c_nationkey, side, round_even(CASE c_nationkey % 5 WHEN 0 THEN s - coalesce(m, 0) WHEN 1 THEN s * 1.05 WHEN 2 THEN s + least(0, coalesce(low, 0)) WHEN 3 THEN s - coalesce(o, 0) ELSE s END, 2) AS total
    FROM (SELECT c_nationkey, side, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS s, max(amount) FILTER (bucket NOT LIKE 'other%') AS m, max(amount) FILTER (bucket LIKE 'other%') AS o FROM ({_BUCKET_SQL}) GROUP BY ALL)
    LEFT JOIN (SELECT c_nationkey, min(value) AS low FROM ({_LINES_SQL}) GROUP BY ALL) USING (c_nationkey)"""


def _checked(buckets: DataFrame, lines: DataFrame) -> DataFrame:
    return sheet.tally(buckets, _printed(buckets, lines), ["c_nationkey", "side"], "amount", "total")


_CHECK_SQL = f"""
    SELECT *, computed - total AS gap, greatest(n, abs(total) * 0.001, 1.0) AS tolerance, abs(computed - total) <= greatest(n, abs(total) * 0.001, 1.0) AS balanced
    FROM (SELECT c_nationkey, side, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS computed, CAST(count(*) FILTER (amount <> 0) AS DOUBLE) AS n FROM ({_BUCKET_SQL}) GROUP BY ALL) JOIN ({_PRINTED_SQL}) USING (c_nationkey, side)"""


def tally_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(_buckets(spark, sf_dir), _contra_lines(spark, sf_dir))
    return rows.select("c_nationkey", "side", half_even(F.col("computed"), 2).alias("computed"), "total", half_even(F.col("gap"), 2).alias("gap"), half_even(F.col("tolerance"), 2).alias("tolerance"), "balanced")


TALLY_CHECK = f"""SELECT c_nationkey, side, round_even(computed, 2) AS computed, total, round_even(gap, 2) AS gap, round_even(tolerance, 2) AS tolerance, balanced FROM ({_CHECK_SQL})"""


def gap_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets, lines, by = _buckets(spark, sf_dir), _contra_lines(spark, sf_dir), ["c_nationkey", "side"]
    checked = _checked(buckets, lines)
    gaps = checked.where("not balanced").select(*by, "gap")
    rows = sheet.diagnose(checked, sheet.nearest_bucket(buckets, gaps, by, "bucket", "amount"), sheet.contra_line(lines, gaps, by, "side", "label", "value"), by)
    text = sheet.diagnosis_text(F.col("side"), F.col("gap"), F.col("diagnosis"), F.coalesce("suspect", "contra"))
    return rows.select(*by, "suspect", half_even(F.col("suspect_amount"), 2).alias("suspect_amount"), "contra", "contra_value", "diagnosis", text.alias("message"))


GAP_DIAGNOSIS = f"""
WITH k AS ({_CHECK_SQL}),
g AS (SELECT *, greatest(1.0, round_even(abs(gap) * 0.01, 0)) AS near FROM k WHERE NOT balanced AND gap > 0),
s AS (SELECT c_nationkey, side, arg_min(bucket, (abs(amount - gap), bucket)) AS suspect, arg_min(amount, (abs(amount - gap), bucket)) AS suspect_amount
      FROM g JOIN ({_BUCKET_SQL}) USING (c_nationkey, side) WHERE bucket NOT LIKE 'other%' AND amount <> 0 AND abs(amount - gap) <= near GROUP BY ALL),
c AS (SELECT c_nationkey, side, arg_min(core, (abs(-value - gap), core, value)) AS contra, arg_min(value, (abs(-value - gap), core, value)) AS contra_value
      FROM g JOIN ({_LINES_SQL}) USING (c_nationkey) WHERE value < 0 AND (tag = '' OR side = 'assets') AND abs(-value - gap) <= near GROUP BY ALL),
d AS (SELECT c_nationkey, side, gap, suspect, round_even(suspect_amount, 2) AS suspect_amount, CASE WHEN suspect IS NULL THEN contra END AS contra, CASE WHEN suspect IS NULL THEN contra_value END AS contra_value,
             CASE WHEN balanced THEN 'balanced' WHEN gap <= 0 THEN 'missing' WHEN suspect IS NULL AND contra IS NOT NULL THEN 'missing_negative' ELSE 'double_count' END AS diagnosis
      FROM k LEFT JOIN s USING (c_nationkey, side) LEFT JOIN c USING (c_nationkey, side))
SELECT c_nationkey, side, suspect, suspect_amount, contra, contra_value, diagnosis, side || ': ' || CASE diagnosis WHEN 'balanced' THEN 'balanced' WHEN 'missing' THEN 'under by ' || format('{{:,.2f}}', abs(gap)) || '; a printed line is not mapped'
       WHEN 'missing_negative' THEN 'over by ' || format('{{:,.2f}}', abs(gap)) || '; the negative line ' || chr(39) || contra || chr(39) || ' is left out'
       ELSE 'over by ' || format('{{:,.2f}}', abs(gap)) || '; ' || coalesce(suspect || ' is counted twice', 'a line is counted twice') END AS message FROM d"""


def tax_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as current liabilities of a customer: their status is the kind of line, every second customer's tax sits in the wrong bucket."""
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in {"P": "Income taxes payable:", "O": "Deferred income", "F": "Accounts payable"}.items() for x in kv]), F.col("o_orderstatus"))
    section = F.when(F.col("o_orderkey") % 7 == 0, " (non-current)").otherwise(" (current)")
    lines = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("[LIABILITY] "), kinds, section).alias("label"), F.floor("o_totalprice").cast("double").alias("value"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 7 != 0).alias("current"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("current") & (F.col("kind") == kind), F.col("value"))), F.lit(0.0))
    sums = lines.groupBy("o_custkey").agg(of("P").alias("tax"), of("O").alias("late"), of("F").alias("rest"))
    wrong = F.when(F.col("o_custkey") % 2 == 0, F.col("tax")).otherwise(0.0)
    buckets = sums.select("o_custkey", (F.col("late") + F.col("tax") - wrong).alias("deferred"), (F.col("rest") + wrong).alias("other_current"))
    return sheet.regroup_tax(buckets, lines.drop("kind", "current"), ["o_custkey"], "label", "value")


TAX_REGROUP = """
WITH l AS (SELECT o_custkey, o_orderstatus AS k, floor(o_totalprice) AS v FROM orders WHERE o_orderkey % 7 <> 0),
s AS (SELECT o_custkey, coalesce(sum(v) FILTER (k = 'P'), 0.0) AS tax, coalesce(sum(v) FILTER (k = 'O'), 0.0) AS late, coalesce(sum(v) FILTER (k = 'F'), 0.0) AS rest, count(*) FILTER (k = 'P') AS n FROM l GROUP BY o_custkey),
a AS (SELECT DISTINCT o_custkey FROM orders),
m AS (SELECT a.o_custkey, coalesce(tax, 0.0) AS tax, coalesce(late, 0.0) AS late, coalesce(rest, 0.0) AS rest, CASE WHEN o_custkey % 2 = 0 AND n > 0 THEN tax ELSE 0.0 END AS moved FROM a LEFT JOIN s USING (o_custkey))
SELECT o_custkey, late + tax AS deferred, rest AS other_current, moved FROM m"""


def other_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose bucket for the rest holds nearly everything; the status of an order is its bucket."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "O", "other_assets").when(F.col("o_orderstatus") == "P", "other_current_assets").otherwise("receivables").alias("bucket"), F.col("o_totalprice").cast(_CENTS).alias("v"))
    buckets = orders.groupBy("o_custkey", "bucket").agg(F.sum("v").cast("double").alias("amount"))
    totals = orders.groupBy("o_custkey").agg(F.sum("v").cast("double").alias("total"))
    return sheet.dumped(buckets, totals, ["o_custkey"], "bucket", "amount", "total").select("o_custkey", "bucket", F.bround("share", 6).alias("share"))


OTHER_SANITY = """
WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'other_assets' WHEN 'P' THEN 'other_current_assets' ELSE 'receivables' END AS bucket, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
b AS (SELECT o_custkey, bucket, CAST(sum(v) AS DOUBLE) AS amount FROM o GROUP BY ALL), t AS (SELECT o_custkey, CAST(sum(v) AS DOUBLE) AS total, count(*) FILTER (bucket = 'receivables') AS n FROM o GROUP BY o_custkey)
SELECT o_custkey, bucket, round_even(amount / total, 6) AS share FROM b JOIN t USING (o_custkey) WHERE n = 0 AND bucket LIKE 'other%' AND total > 0 AND amount > 0.6 * total"""


def side_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each side's sum counts: buckets and the memo fields of the side, one of which counts on both."""
    memo = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.element_at(F.array(F.lit("custodial"), F.lit("client_cash"), F.lit("leases")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("bucket"), F.abs("s_acctbal").cast(_CENTS).alias("amount"))
    memo = memo.groupBy("c_nationkey", "bucket").agg(F.sum("amount").cast("double").alias("amount"))
    rows = sheet.side_entries(_buckets(spark, sf_dir), memo, {"assets": ["custodial", "client_cash"], "liabilities": ["custodial", "leases"]})
    return rows.groupBy("c_nationkey", "side").agg(F.count_if(F.col("amount") != 0).alias("entries"), F.sum(F.col("amount").cast(_CENTS)).cast("double").alias("sum"))


SIDE_ENTRIES = f"""
WITH m AS (SELECT s_nationkey AS c_nationkey, ['custodial', 'client_cash', 'leases'][s_suppkey % 3 + 1] AS bucket, CAST(sum(CAST(abs(s_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM supplier GROUP BY ALL),
e AS (SELECT c_nationkey, side, amount FROM ({_BUCKET_SQL}) UNION ALL SELECT c_nationkey, 'assets', amount FROM m WHERE bucket <> 'leases' UNION ALL SELECT c_nationkey, 'liabilities', amount FROM m WHERE bucket <> 'client_cash')
SELECT c_nationkey, side, count(*) FILTER (amount <> 0) AS entries, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM e GROUP BY c_nationkey, side"""


def schema_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose fields are not exactly the wanted ones."""
    names = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("result"), F.when(F.col("c_custkey") % 9 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"))
    rows = sheet.schema_faults(names, ["result"], "name", ["automobile", "building", "furniture", "household", "machinery", "vehicles"])
    return rows.select("result", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


SCHEMA_SHAPE = """
WITH n AS (SELECT DISTINCT c_custkey % 40 AS result, CASE WHEN c_custkey % 9 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS name FROM customer),
w AS (SELECT unnest(['automobile', 'building', 'furniture', 'household', 'machinery', 'vehicles']) AS name),
m AS (SELECT result, string_agg(w.name, ',' ORDER BY w.name) AS missing FROM (SELECT DISTINCT result FROM n) r, w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.result = r.result AND n.name = w.name) GROUP BY result),
u AS (SELECT result, string_agg(name, ',' ORDER BY name) AS unexpected FROM n WHERE name NOT IN (SELECT name FROM w) GROUP BY result)
SELECT result, coalesce(missing, '') AS missing, coalesce(unexpected, '') AS unexpected FROM m FULL JOIN u USING (result)"""


def chain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities used more often in shipped lines (F) than printed in open ones (O), per part."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_linestatus")
    return sheet.overused(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), ["l_partkey", "l_quantity"])


CHAIN_DUPLICATES = """
WITH c AS (SELECT l_partkey, l_quantity, count(*) FILTER (l_linestatus = 'F') AS n_used, count(*) FILTER (l_linestatus = 'O') AS n_printed FROM lineitem GROUP BY ALL)
SELECT * FROM c WHERE n_printed > 0 AND n_used > n_printed"""


def better_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of each customer and status: the one whose total is nearer to 150000 is kept, ties keep the retry."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("side"), (F.col("o_orderkey") % 2).alias("half")).agg(F.sum(F.col("o_totalprice").cast(_CENTS)).cast("double").alias("total"))
    run = lambda half: sums.where(F.col("half") == half).select("o_custkey", "side", "total", F.bround(F.col("total") - 150000, 2).alias("gap"))
    return sheet.better_side(run(0), run(1), ["o_custkey", "side"], "gap")


BETTER_SIDE = """
WITH s AS (SELECT o_custkey, o_orderstatus AS side, o_orderkey % 2 + 1 AS run, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL),
r AS (SELECT o_custkey, side, total, round_even(total - 150000, 2) AS gap, CAST(run AS INTEGER) AS run, row_number() OVER (PARTITION BY o_custkey, side ORDER BY abs(round_even(total - 150000, 2)), run DESC) AS k FROM s)
SELECT o_custkey, side, total, gap, run FROM r WHERE k = 1"""


def equity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity-like buckets of a nation, claimed as the largest or the sum of its labelled lines or as an invented amount."""
    word = F.element_at(F.array(F.lit("Preferred shares"), F.lit("Redeemable interests"), F.lit("Common stock"), F.lit("Temporary equity")), (F.col("c_custkey") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "customer").select("c_nationkey", word.alias("label"), F.floor("c_acctbal").cast("double").alias("value"))
    preferred, mezzanine = F.col("label") == "Preferred shares", F.col("label") != "Common stock"
    sums = lines.groupBy("c_nationkey").agg(F.max(F.when(preferred, F.col("value"))).alias("p"), F.sum(F.when(mezzanine, F.col("value"))).alias("m"))
    claim = F.expr("stack(3, 'preferred_stock', p + if(c_nationkey % 2 = 0, 0D, 0.25D), 'mezzanine_equity', m + if(c_nationkey % 3 = 0, 0D, 0.25D), 'common_equity', 7D) as (bucket, amount)")
    return sheet.backed(sums.select("c_nationkey", claim), lines, ["c_nationkey"], "bucket", "amount", "label", "value")


EQUITY_GUARD = """
WITH l AS (SELECT c_nationkey, c_custkey % 4 AS k, floor(c_acctbal) AS v FROM customer),
s AS (SELECT c_nationkey, max(v) FILTER (k = 0) AS p, sum(v) FILTER (k <> 2) AS m FROM l GROUP BY ALL)
SELECT c_nationkey, 'preferred_stock' AS bucket, CASE WHEN c_nationkey % 2 = 0 AND p IS NOT NULL THEN p ELSE 0.0 END AS amount FROM s
UNION ALL SELECT c_nationkey, 'mezzanine_equity', CASE WHEN c_nationkey % 3 = 0 AND m IS NOT NULL THEN m ELSE 0.0 END FROM s
UNION ALL SELECT c_nationkey, 'common_equity', 7.0 FROM s"""


def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("thousands"), F.lit("Millions "), F.lit("billions"), F.lit("units"), F.lit("furlongs"), F.lit(None)), (F.col("p_size") % 6 + 1).cast("int"))
    amount, warning = sheet.to_millions(F.col("p_retailprice") * 1003, unit)
    short, long_, total = sheet.debt(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")), F.when(F.col("p_size") % 3 == 0, F.lit(100.0)))
    return table(spark, sf_dir, "part").select("p_partkey", amount.alias("amount"), warning.alias("warning"), F.bround(short, 2).alias("short_debt"), long_.alias("long_debt"), F.bround(total, 2).alias("total_debt"))


UNIT_NORMALISE = """
WITH u AS (SELECT *, ['thousands', 'millions', 'billions', 'units', 'furlongs', NULL][p_size % 6 + 1] AS unit, [1e-3, 1e0, 1e3, 1e-6, NULL, NULL][p_size % 6 + 1] AS f,
                  CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0.0 END AS s, CASE WHEN p_size % 3 = 0 THEN 100.0 ELSE 0.0 END AS l FROM part)
SELECT p_partkey, round_even(p_retailprice * 1003 * coalesce(f, 1e-6), 3) AS amount, CASE WHEN f IS NULL THEN 'unknown unit: ' || coalesce(unit, 'none') END AS warning,
       round_even(s, 2) AS short_debt, CAST(l AS DOUBLE) AS long_debt, round_even(s + l, 2) AS total_debt FROM u"""


def liabilities_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liabilities derived from equity where none is printed, and the first candidate that a reference confirms."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(_CENTS)).cast("double").alias("assets"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast(_CENTS))).cast("double").alias("equity"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("printed"))
    derived = sheet.derived_liabilities(F.col("assets"), sheet.printed_first(F.col("printed"), F.lit(None).cast("double")), F.col("equity"))
    rows = orders.withColumn("liabilities", derived)
    candidates = rows.select("o_custkey", F.posexplode(F.array("liabilities", F.col("assets") - F.col("equity"), F.col("assets"))).alias("candidate_pos", "candidate")).where("candidate is not null")
    references = rows.select("o_custkey", F.posexplode(F.array(F.col("assets") - F.col("equity"), F.col("assets") * 0.999)).alias("reference_pos", "reference")).where("reference is not null")
    sound = sheet.independent_total(candidates, references, ["o_custkey"])
    return rows.join(sound, "o_custkey", "left").select("o_custkey", F.bround("liabilities", 2).alias("liabilities"), F.bround("candidate", 2).alias("confirmed"))


LIABILITIES_GUARD = """
WITH o AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS e, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey),
l AS (SELECT *, coalesce(p, CASE WHEN e > 0 AND e < a THEN a - e END) AS l FROM o),
c AS (SELECT o_custkey, unnest([0, 1, 2]) AS cp, unnest([l, a - e, a]) AS c FROM l), r AS (SELECT o_custkey, unnest([0, 1]) AS rp, unnest([a - e, a * 0.999]) AS r FROM l),
b AS (SELECT o_custkey, arg_min(c, (cp, rp)) AS c FROM c JOIN r USING (o_custkey) WHERE c IS NOT NULL AND r IS NOT NULL AND abs(c - r) <= 0.01 * abs(r) GROUP BY o_custkey)
SELECT o_custkey, round_even(l, 2) AS liabilities, round_even(c, 2) AS confirmed FROM l LEFT JOIN b USING (o_custkey)"""


def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements that print one total for both sides: equity by all lines but the first or by the first, confirmed only by lines that it does not rest on."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_extendedprice").cast(_CENTS)).cast("double").alias("v"))
    sums = lines.groupBy("l_orderkey").agg(F.bround(F.sum("v"), 2).alias("assets"), F.array_sort(F.collect_list(F.struct("l_linenumber", "v"))).alias("lines"))
    total = lambda rows: F.bround(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["v"]), 2)
    facts = lambda rows: F.transform(rows, lambda x: F.concat(F.lit("line"), x["l_linenumber"].cast("string")))
    first, rest, even = F.slice("lines", 1, 1), F.slice("lines", 2, F.size("lines")), F.col("l_orderkey") % 2 == 0
    totals = sums.select("l_orderkey", "assets", F.when(F.col("l_orderkey") % 4 > 0, F.col("assets")).otherwise(F.col("assets") + 1).alias("liabilities"))
    equity = sums.select("l_orderkey", F.posexplode(F.array(*[F.struct(total(x).alias("equity"), facts(x).alias("facts")) for x in (rest, first)])).alias("pos", "e")).select("l_orderkey", "pos", "e.*")
    # Said to be liabilities: the first line of even orders, else the lines after it. Every third order's reference rests on the assets themselves.
    said = F.when(even, first).otherwise(rest)
    own = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("assets"))).otherwise(F.array().cast("array<string>"))
    references = sums.select("l_orderkey", F.lit(0).alias("pos"), total(said).alias("reference"), F.size(said).alias("n_lines"), F.when(even, "the first line").otherwise("later lines").alias("label"), F.concat(facts(said), own).alias("facts"))
    return sheet.liabilities_only(totals, equity, references, ["l_orderkey"]).select("l_orderkey", F.bround("liabilities", 2).alias("liabilities"), "warning")


GRAND_TOTALS = """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, round_even(sum(v), 2) AS assets, round_even(arg_min(v, l_linenumber), 2) AS one, min(l_linenumber) AS low, count(*) AS n FROM l GROUP BY l_orderkey),
t AS (SELECT s.*, round_even(coalesce(sum(v), 0), 2) AS rest FROM s LEFT JOIN l ON l.l_orderkey = s.l_orderkey AND l_linenumber > low GROUP BY ALL),
c AS (SELECT l_orderkey, assets, unnest([0, 1]) AS pos, unnest([rest, one]) AS equity, unnest(['rest', 'one']) AS facts, CASE WHEN l_orderkey % 2 = 0 THEN one ELSE rest END AS reference, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE n - 1 END AS lines, CASE WHEN l_orderkey % 2 = 0 THEN 'one' ELSE 'rest' END AS said FROM t WHERE l_orderkey % 4 > 0 AND l_orderkey % 3 > 0),
m AS (SELECT l_orderkey, arg_min(round(assets - equity, 3), pos) AS d FROM c WHERE equity > 0 AND equity < assets AND facts <> said AND abs(round(assets - equity, 3) - reference) <= greatest(lines, abs(assets - equity) * 0.001, 1) GROUP BY l_orderkey)
SELECT l_orderkey, round_even(CASE WHEN d IS NOT NULL THEN d WHEN l_orderkey % 4 > 0 THEN assets ELSE assets + 1 END, 2) AS liabilities,
       CASE WHEN d IS NOT NULL THEN 'grand total taken apart, confirmed by ' || CASE WHEN l_orderkey % 2 = 0 THEN 'the first line' ELSE 'later lines' END WHEN l_orderkey % 4 > 0 THEN 'grand total, no equity confirmed' END AS warning FROM t LEFT JOIN m USING (l_orderkey)"""


def final_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct amounts of an order in its header and its lines, without signs."""
    header = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.array(-F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity"))).alias("amount"))
    values = sheet.final_values([header, lines], ["o_orderkey"])
    return values.select("o_orderkey", F.size("values").cast("long").alias("n"), F.bround(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


FINAL_VALUES = """
WITH v AS (SELECT o_orderkey, round(abs(o_totalprice), 4) AS v FROM orders UNION SELECT l_orderkey, round(abs(l_quantity), 4) FROM lineitem UNION SELECT l_orderkey, round(abs(l_discount), 4) FROM lineitem)
SELECT o_orderkey, count(*) FILTER (v <> 0) AS n, round_even(coalesce(sum(v) FILTER (v <> 0), 0), 2) AS total FROM v GROUP BY o_orderkey"""


def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines: a user turn opens a side by its parity, a long text is a section heading, a short one ends the section."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    side = F.when(F.col("role") == "user", F.when(F.col("n") % 2 == 0, "assets").otherwise("liabilities"))
    section = F.when(F.col("n") > 400, "current")
    carried = sheet.carry_sections(lines, ["conv_id"], "turn", side, section, F.col("n") < 80)
    return carried.select("conv_id", "turn", "side", "section")


SECTION_CARRY = """
WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN length(text) % 2 = 0 THEN 'assets' ELSE 'liabilities' END END AS s, CASE WHEN length(text) > 400 THEN 'current' END AS c, length(text) < 80 AS t FROM conversations),
a AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS side, last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l),
b AS (SELECT *, sum(CASE WHEN s IS NOT NULL AND s IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a),
d AS (SELECT *, coalesce(c, lag(CASE WHEN t THEN 'non_current' END) OVER (PARTITION BY conv_id, run ORDER BY turn)) AS mark FROM b)
SELECT conv_id, turn, side, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id, run ORDER BY turn) AS section FROM d"""


def parent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in key order per customer, rounded to tens of thousands; a priority is the label, two of them are parents."""
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("[ASSET] "), "o_orderpriority").alias("label"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("value"))
    return sheet.parents(lines, ["o_custkey"], "o_orderkey", "label", "value", {"1-urgent": True, "5-low": False}, most=4)


PARENT_LINES = """
WITH o AS (SELECT o_custkey, o_orderkey, lower(o_orderpriority) AS parent, floor(o_totalprice / 10000) AS v FROM orders),
w AS (SELECT *, lead(v, 1) OVER k AS a, lead(v, 2) OVER k AS b, lead(v, 3) OVER k AS c, lead(v, 4) OVER k AS d, min(o_orderkey) OVER (PARTITION BY o_custkey, parent) AS f FROM o WINDOW k AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
n AS (SELECT *, CASE WHEN abs(a - v) <= 2 THEN 1 WHEN a > v + 2 THEN NULL WHEN abs(a + b - v) <= 2 THEN 2 WHEN a + b > v + 2 THEN NULL WHEN abs(a + b + c - v) <= 3 THEN 3 WHEN a + b + c > v + 3 THEN NULL WHEN abs(a + b + c + d - v) <= 4 THEN 4 END AS n_parts
      FROM w WHERE o_orderkey = f AND v <> 0 AND parent IN ('1-urgent', '5-low'))
SELECT o_custkey, parent, o_orderkey, CAST(n_parts AS BIGINT) AS n_parts, parent = '1-urgent' AS keep_parent FROM n WHERE n_parts IS NOT NULL"""


def printed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of printed chains such as ``12 + 30 - 4`` made of an order's lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"].cast("string")), " + ").alias("chain"), F.max("l_linenumber").alias("n"))
    chain = F.concat("chain", F.lit(" + -"), F.col("n").cast("string"))
    return rows.select("l_orderkey", chain.alias("chain"), sheet.chain_sum(chain).alias("total"))


PRINTED_CHAINS = """
SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ' + ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || ' + -' || max(l_linenumber) AS chain, sum(l_quantity) - max(l_linenumber) AS total FROM lineitem GROUP BY l_orderkey"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as consensus points: (customer, epoch ms of the month's end, series, value)."""
    end = F.last_day(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.datediff(end, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).alias("ms"), F.when(F.col("o_orderstatus") == "F", "revenue").otherwise("eps").alias("series"), F.col("o_totalprice").alias("value"))


def forecast_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end sums by series, half-even; months without a forecast row come from the finished orders."""
    points = _points(spark, sf_dir).groupBy((F.col("o_custkey") % 20).alias("g"), "ms", "series").agg(F.sum(F.col("value").cast(_CENTS)).cast("double").alias("value"))
    wide = forecast.pivot_periods(points, ["g"], "ms", "series", "value", ["revenue", "eps"], {"eps": 2})
    late = wide.where("period >= '1998'")
    return forecast.with_actuals(late, wide, ["g", "period"])


FORECAST_PIVOT = """
WITH p AS (SELECT o_custkey % 20 AS g, strftime(o_orderdate, '%Y-%m') AS period, round_even(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE), 0) AS revenue, round_even(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F') AS DOUBLE), 2) AS eps FROM orders GROUP BY ALL)
SELECT * FROM p"""


def year_end_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.year_end_month(_points(spark, sf_dir), ["o_custkey"], "ms", "o_orderkey").select("o_custkey", F.col("fye_month").cast("long").alias("fye_month"))


YEAR_END_MONTH = """
WITH c AS (SELECT o_custkey, month(o_orderdate) AS m, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS k FROM c)
SELECT o_custkey, m AS fye_month FROM r WHERE k = 1"""


def summary_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct()
    return forecast.summary(months, ["o_custkey"], "period", "2001").select("o_custkey", "period", F.col("rank").cast("long").alias("rank"), "period_end")


SUMMARY_TOP3 = """
WITH m AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, strftime(last_day(o_orderdate), '%d/%m/%Y') AS period_end FROM orders WHERE NOT starts_with(strftime(o_orderdate, '%Y-%m'), '2001')),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY period DESC) AS rank FROM m)
SELECT o_custkey, period, rank, period_end FROM r WHERE rank <= 3"""


def estimate_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over the year before; a customer's zero or missing year gives no growth."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast(_CENTS))).cast("double").alias("eps"))
    return forecast.growth(rows, ["o_custkey"], "year", "eps").select("o_custkey", "year", F.bround("growth", 6).alias("growth"))


ESTIMATE_YOY = """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS eps FROM orders GROUP BY ALL)
SELECT o_custkey, year, round_even(eps / NULLIF(lag(eps) OVER (PARTITION BY o_custkey ORDER BY year), 0) - 1, 6) AS growth FROM y"""


def margin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements made of customers: the first broken rule of each."""
    k = F.col("c_custkey")
    target = F.col("c_acctbal") / 20000
    rows = table(spark, sf_dir, "customer").withColumn("target", target)
    eps = F.array(F.when(k % 4 == 0, -1.0).otherwise(1.0), F.when(k % 5 == 0, None).otherwise(-0.5))
    comps = F.array(F.concat(F.lit("Alpha ~$"), F.format_string("%d.5", k % 7 + 1), F.lit("B revenue ~"), (k % 30).cast("string"), F.lit("% margin")), F.lit("Beta with no figures"))
    history = F.array(F.struct(F.lit("FY2023").alias("period"), F.lit(900.0).alias("revenue")), F.struct(F.lit("TTM 2024").alias("period"), ((k % 9) * 1000.0).alias("revenue")))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("FAST_GROWER", "ASSET_PLAY", "STALWART", "OTHER")]), (k % 4 + 1).cast("int"))
    out = margin.judged(
        rows, target=F.col("target"), classification=kind, confidence=F.when(k % 11 == 0, "none").otherwise("high"), us_anchor=F.when(k % 2 == 0, 0.01).otherwise(0.25), global_anchor=F.lit(0.1),
        mature_anchor=F.when(k % 3 == 0, None).otherwise(0.3), past_average=F.lit(0.2), eps=eps, driver=k % 6 == 1, comps=comps, subject_revenue=margin.ttm_revenue(history), rationale=F.when(k % 13 == 0, " ").otherwise("because"),
    )
    return out.select("c_custkey", F.coalesce("error", F.lit("accepted")).alias("error"))


MARGIN_RULES = """
WITH c AS (SELECT c_custkey AS k, c_acctbal / 20000 AS t, ['FAST_GROWER', 'ASSET_PLAY', 'STALWART', 'OTHER'][c_custkey % 4 + 1] AS kind, CASE WHEN c_custkey % 2 = 0 THEN 0.01 ELSE 0.25 END AS us, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.3 END AS mature,
                  (c_custkey % 7 + 1.5) * 1000 AS rev, (c_custkey % 30) / 100.0 AS cm, (c_custkey % 9) * 1000.0 AS subject FROM customer),
a AS (SELECT *, greatest(us, 0.1, coalesce(mature, 0.0)) AS anchor FROM c)
SELECT k AS c_custkey, CASE WHEN kind = 'OTHER' THEN 'classification' WHEN k % 11 = 0 THEN 'confidence' WHEN t < -0.05 OR t > 0.6 THEN 'range' WHEN t > anchor * 1.5 THEN 'anchor_cap'
    WHEN k % 4 = 0 AND t > 0.6 * anchor THEN 'negative_eps' WHEN us < 0.05 AND kind = 'FAST_GROWER' AND t < 0.3 * mature THEN 'distorted_anchor' WHEN kind = 'ASSET_PLAY' AND k % 6 = 1 THEN 'asset_play_driver'
    WHEN kind = 'ASSET_PLAY' AND abs(t - 0.2) > 0.000001 THEN 'asset_play_average' WHEN t < cm - 0.1 OR t > cm + 0.1 THEN 'comp_band' WHEN subject > 0 AND (rev / subject < 0.3 OR rev / subject > 3.0) THEN 'comp_scale'
    WHEN k % 13 = 0 THEN 'rationale' ELSE 'accepted' END AS error FROM a"""
