"""The report of a filing as seven tables: summary, roll-forward, tranches, valuation inputs, descriptions, key figures, data quality.

Each function takes the plans (or tranches) of many filings at once; ``by`` names the columns of a filing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.codes import has_value
from finsheet.operators import plans as award


def fair_value(option_value, grant_date_value) -> Column:
    """Fair value of one award: the option-pricing value, else the grant-date one."""
    return F.coalesce(F.col(option_value), F.col(grant_date_value))


def type_label(plan_type, nil_cost, cash_settled) -> Column:
    """Plan type with what is known of its cost and settlement in brackets."""
    extras = F.concat_ws(", ", F.when(F.col(nil_cost), F.lit("Nil-cost")), F.when(F.col(cash_settled), F.lit("Cash-settled")).when(~F.col(cash_settled), F.lit("Equity-settled")))
    name = F.coalesce(F.col(plan_type), F.lit("—"))
    return F.when(extras == "", name).otherwise(F.concat(name, F.lit(" ("), extras, F.lit(")")))


def description(fields: dict[str, str]) -> Column:
    """What a plan's fields say, sentence by sentence; years of vesting only where no text tells of it.

    ``fields`` maps description, vesting, vesting_years, conditions, performance_years, holding_years and payout to columns.
    """
    c = {k: F.col(v) for k, v in fields.items()}
    said = lambda k, before, after: F.when(has_value(c[k]), F.concat(F.lit(before), c[k].cast("string"), F.lit(after)))
    years = F.when(c["vesting_years"].isNotNull() & ~has_value(c["vesting"]), F.concat(F.lit("Vesting period: "), c["vesting_years"].cast("string"), F.lit(" years.")))
    text = F.concat_ws(
        " ", F.when(has_value(c["description"]), c["description"]), said("vesting", "Vesting: ", "."), years, said("conditions", "Performance conditions: ", "."),
        said("performance_years", "Performance period: ", " years."), said("holding_years", "Holding period: ", " years post-vesting."), said("payout", "Maximum payout: ", "% of baseline."),
    )
    return F.when(text == "", "No description disclosed.").otherwise(text)


def with_last_runs(tranches: DataFrame, by: list[str], plan: str, pos: str) -> DataFrame:
    """``tranches`` with the first and last row (from 1) of their plan's last run of consecutive tranches; those without a plan count and go.

    Windows over the filing alone, so nothing is joined and rows dealt by filing are not shuffled.
    """
    filing, of_plan = Window.partitionBy(*by).orderBy(pos), Window.partitionBy(*by, plan)
    rows = tranches.withColumns({"__row": F.row_number().over(filing), "__before": F.lag(plan).over(filing)}).where(reduce(and_, [F.col(c).isNotNull() for c in (*by, plan)]))
    start = F.when((F.col("__row") == 1) | ~F.col("__before").eqNullSafe(F.col(plan)), F.col("__row"))
    return rows.withColumns({"first_row": F.max(start).over(of_plan), "last_row": F.max("__row").over(of_plan)}).drop("__row", "__before")


def reports(plans: DataFrame, tranches: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """The seven tables of a report.

    ``plans`` has plan_name, plan_type, is_nil_cost, is_cash_settled, opening, granted, exercised, lapsed, closing, units_label,
    volatility, risk_free_rate, expected_term, option_value, grant_date_value and the text fields of ``description`` by their
    names; ``tranches`` has plan_name, pos, grant_date, outstanding and price.
    """
    flows = ["opening", "granted", "exercised", "lapsed", "closing"]
    has_flows = F.coalesce(*[F.col(c).cast("double") for c in flows]).isNotNull()
    gap = award.rollforward_gap("opening", "granted", "exercised", "lapsed", "closing")
    inputs = ["volatility", "risk_free_rate", "expected_term"]
    filled = lambda c: F.count(c)
    summary = plans.groupBy(*by).agg(F.count(F.lit(1)).alias("plans"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in flows], F.count_if(F.col("is_nil_cost")).alias("nil_cost_plans"))
    roll = plans.where(has_flows).select(*by, "plan_name", *flows, F.bround(gap, 2).alias("gap"), award.math_check("opening", F.col("granted"), F.col("exercised"), F.col("lapsed"), "closing").alias("check"))
    rows = with_last_runs(tranches, by, "plan_name", "pos").select(*by, "plan_name", "pos", "grant_date", "outstanding", "price", "first_row", "last_row")
    valued = plans.select(*by, "plan_name", fair_value("option_value", "grant_date_value").alias("fair_value"), *inputs).where(F.coalesce("fair_value", *[F.col(c).cast("double") for c in inputs]).isNotNull())
    told = plans.where(has_value("plan_name") | has_value("description"))
    texts = told.select(*by, F.coalesce("plan_name", F.lit("—")).alias("plan_name"), type_label("plan_type", "is_nil_cost", "is_cash_settled").alias("plan_type"), description({k: k for k in ("description", "vesting", "vesting_years", "conditions", "performance_years", "holding_years", "payout")}).alias("text"))
    rate = lambda c: F.try_divide(F.sum(c), F.sum("opening"))
    figures = plans.groupBy(*by).agg(F.bround(rate("granted"), 6).alias("grant_rate"), F.bround(rate("exercised"), 6).alias("exercise_rate"), F.bround(rate("lapsed"), 6).alias("lapse_rate"), F.bround(F.try_divide(F.sum("closing") - F.sum("opening"), F.sum("opening")), 6).alias("change"))
    quality = plans.groupBy(*by).agg(F.count(F.lit(1)).alias("plans"), *[filled(c).alias(f"with_{c}") for c in (*flows, *inputs)], F.count_if(~award.rollforward_ok(gap, "closing")).alias("rollforward_mismatches"))
    return {"summary": summary, "rollforward": roll, "tranches": rows, "valuation": valued, "descriptions": texts, "figures": figures, "quality": quality}
