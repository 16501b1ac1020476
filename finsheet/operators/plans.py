"""Award plans: classification, reduction, roll-forward checks, merging, roll-up reports.

Every function takes and gives DataFrames; ``by`` names the columns that identify a filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.coerce import millions, once, real

#: The number fields of a plan that the strict reducer may take a strike or a maturity from.
STRICT_FIELDS = ("weighted_avg_exercise_price", "weighted_avg_grant_date_fair_value", "vesting_period_years", "weighted_avg_expense_recognition_years", "weighted_avg_remaining_contractual_life_years")


def classify(plans: DataFrame) -> DataFrame:
    """Plans with an exercise price or nil-cost awards, with count_mn, strike, maturity_years and kind; the rest go.

    Expects plan_type, is_nil_cost, units_label, closing_balance, weighted_avg_exercise_price,
    weighted_avg_grant_date_fair_value, weighted_avg_remaining_contractual_life_years, vesting_period_years.
    """
    read = once(plans, count_mn=millions("closing_balance", "units_label"), __price=real("weighted_avg_exercise_price"), __fair=real("weighted_avg_grant_date_fair_value"), maturity_years=F.coalesce(real("weighted_avg_remaining_contractual_life_years"), real("vesting_period_years"), F.lit(4.0)))
    nil, count = F.col("is_nil_cost"), F.col("count_mn")
    espp = F.upper(F.trim(F.coalesce("plan_type", F.lit("")))) == "ESPP"
    kind = F.when(count.isNull() | (espp & (count <= 0)), None).when(F.col("__price").isNotNull() & nil.eqNullSafe(F.lit(False)), "option").when(nil.eqNullSafe(F.lit(True)), "rsu")
    strike = F.when(F.col("kind") == "option", F.col("__price")).when(F.col("kind") == "rsu", F.coalesce(F.nullif(F.col("__fair"), F.lit(0.0)), F.lit(0.1)))
    return read.withColumn("kind", kind).where("kind is not null").withColumn("strike", strike).drop("__price", "__fair")


def sanitise(rows: DataFrame) -> DataFrame:
    """Positive counts and strikes only; a maturity that is not positive is 4 years."""
    return rows.where("count_mn > 0 and strike > 0").withColumn("maturity_years", F.when(F.col("maturity_years") > 0, F.col("maturity_years")).otherwise(4.0))


def strict(plans: DataFrame) -> DataFrame:
    """Like ``classify`` without made-up values: strike and maturity may be NULL and each says where it came from."""
    nil = F.col("is_nil_cost").eqNullSafe(F.lit(True))
    numbers = {"count_mn": millions("closing_balance", "units_label"), **{f"__{n}": real(n) for n in STRICT_FIELDS}}
    read = once(plans, **numbers)
    chain = lambda *names: F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.struct(F.col(f"__{n}").alias("value"), F.lit(n).alias("field"))) for n in names])
    strike = F.when(nil, chain("weighted_avg_grant_date_fair_value")).otherwise(chain("weighted_avg_exercise_price"))
    maturity = F.when(nil, chain("vesting_period_years", "weighted_avg_expense_recognition_years")).otherwise(chain("weighted_avg_remaining_contractual_life_years", "vesting_period_years"))
    rows = read.where("count_mn > 0").withColumns({"s": strike, "m": maturity, "kind": F.when(F.col("is_nil_cost"), "rsu").otherwise("option")})
    return rows.select("*", F.col("s.value").alias("strike"), F.col("s.field").alias("strike_field"), F.col("m.value").alias("maturity_years"), F.col("m.field").alias("maturity_field")).drop("s", "m", *[f"__{n}" for n in STRICT_FIELDS])


def top_plans(rows: DataFrame, by: list[str], tie: list[str], n: int = 3) -> DataFrame:
    """The n largest plans of each filing; ``tie`` must make the order total."""
    order = Window.partitionBy(*by).orderBy(F.desc("count_mn"), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rollforward_gap(opening, granted, exercised, lapsed, closing, vested=None, settled=None) -> Column:
    """Smallest absolute gap of the roll-forward formulas; NULL when opening or closing is missing."""
    z = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) if c is not None else F.lit(0.0)
    o, c = (F.col(x) if isinstance(x, str) else x for x in (opening, closing))
    base = o + z(granted) - z(exercised) - z(lapsed)
    return F.array_min(F.array(*[F.abs(e - c) for e in (base, base - z(vested), base - z(settled), base - z(vested) - z(settled))]))


def rollforward_ok(gap: Column, closing, relative: float = 0.01, absolute: float = 1.0) -> Column:
    return gap <= F.greatest(F.abs(F.col(closing) if isinstance(closing, str) else closing) * relative, F.lit(absolute))


def prior_rollforward_gap(opening, granted, exercised, lapsed, closing, vested) -> Column:
    """Smallest absolute gap of the two prior-year formulas, without and with the vested units."""
    return rollforward_gap(opening, granted, exercised, lapsed, closing, vested)


def years_meet(prior_closing, opening) -> Column:
    """Whether the prior year ends where this year starts, within 1 % and one unit; NULL where either is missing."""
    p, o = (F.col(x) if isinstance(x, str) else x for x in (prior_closing, opening))
    return F.abs(p - o) <= F.greatest(F.abs(o) * 0.01, F.lit(1.0))


def negative_flow(exercised, lapsed, vested) -> Column:
    """Whether a flow that is printed as a positive number is negative."""
    return F.least(*[F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0)) for x in (exercised, lapsed, vested)]) < 0


def over_exercisable(exercisable, closing) -> Column:
    """Whether more is exercisable than there is; false where either is missing."""
    return F.coalesce((F.col(exercisable) if isinstance(exercisable, str) else exercisable) > (F.col(closing) if isinstance(closing, str) else closing), F.lit(False))


def math_check(opening, granted, exercised, lapsed, closing) -> Column:
    """The report's own check: one formula, one unit of tolerance."""
    gap = F.abs(F.col(opening) + F.coalesce(granted, F.lit(0.0)) - F.coalesce(exercised, F.lit(0.0)) - F.coalesce(lapsed, F.lit(0.0)) - F.col(closing))
    return F.when(gap.isNull(), "n/a").when(gap <= 1, "ok").otherwise("check")


def warnings(*pairs: tuple[Column, str]) -> Column:
    """Messages of the conditions that hold, in the given order."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]), lambda w: w.isNotNull())


def first_filled(batches: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """Merge batches: for each key and field the first non-null value in batch order."""
    return batches.groupBy(*key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def merge_tranches(tranches: DataFrame, key: list[str], order: str, date: str) -> DataFrame:
    """First batch's tranches and later ones of a date not seen in an earlier batch; rows without a date all stay."""
    first = Window.partitionBy(*key, date)
    lowest = Window.partitionBy(*key)
    rows = tranches.withColumn("__seen", F.min(order).over(first)).withColumn("__low", F.min(order).over(lowest))
    return rows.where(F.col(date).isNull() | (F.col(order) == F.col("__seen"))).drop("__seen", "__low")


def totals(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(f"total_{m}") for m in measures])


def change(current: Column, prior: Column) -> tuple[Column, Column]:
    """(difference, relative difference), NULL where there is nothing to compare with."""
    return current - prior, F.try_divide(current - prior, prior)


def tranche_subtotals(rows: DataFrame, by: list[str], shares: str, price: str) -> DataFrame:
    """Count, sum, least and greatest price, share-weighted price for each group and for all of them together."""
    s, p = F.col(shares), F.col(price)
    out = rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("shares"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.try_divide(F.sum(s * p), F.sum(s)).alias("avg_price"), F.grouping_id().alias("level"))
    return out


def units_consensus(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``absolute`` without any label, the label if there is one, else ``mixed``."""
    unit = F.nullif(F.lower(F.trim(F.col(label))), F.lit(""))
    n = F.count_distinct(unit)
    return rows.groupBy(*by).agg(F.when(n == 0, "absolute").when(n == 1, F.max(unit)).otherwise("mixed").alias("units"))


def completeness(rows: DataFrame, plan: str, checks: dict[str, Column], plans: list) -> DataFrame:
    """Matrix of checks by plan: how many rows pass; checks that nothing passes are left out."""
    named = rows.select(F.col(plan).alias("plan"), F.explode(F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), c)])).alias("check", "ok"))
    return named.where("ok").groupBy("check").pivot("plan", plans).agg(F.count(F.lit(1))).na.fill(0)


def parameter_matrix(rows: DataFrame, plan: str, parameters: list[str], plans: list) -> DataFrame:
    """Parameters down, plans across; parameters without a value are left out."""
    long = rows.select(F.col(plan).alias("plan"), F.explode(F.create_map(*[x for p in parameters for x in (F.lit(p), F.col(p).cast("double"))])).alias("parameter", "value"))
    return long.where("value is not null").groupBy("parameter").pivot("plan", plans).agg(F.min("value"))


def filled_columns(df: DataFrame, always: list[str]) -> DataFrame:
    """Report columns that hold anything, and ``always``. One aggregate decides; use it at the very end."""
    other = [c for c in df.columns if c not in always]
    n = df.agg(*[F.count(c).alias(c) for c in other]).first()
    return df.select(*always, *[c for c in other if n[c]])
