"""Tagged facts of a filing to award-plan rows: concepts, periods, slots, first values, merging, pivot.

Facts are rows (filing, pos, concept, value, numeric_value, unit_ref, period_start, period_end, period_instant,
dims map) and filings rows (filing, period_of_report); a cluster holds many filings at once and every step is keyed
by filing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.coerce import duration_years, fact_number, once
from finsheet.functions.dates import days_apart
from finsheet.functions.maps import AWARDS
from finsheet.functions.text import local_name

#: Endings of taxonomy concepts for each field, by family.
OPTION_FIELDS = {
    "outstanding_number": "OptionsOutstandingNumber$",
    "outstanding_waep": "OptionsOutstandingWeightedAverageExercisePrice$",
    "granted": "OptionsGrantsInPeriod(Gross|Net)?$",
    "granted_waep": "OptionsGrantsInPeriodWeightedAverageExercisePrice$",
    "granted_wagdfv": "OptionsGrantsInPeriodWeightedAverageGrantDateFairValue$",
    "exercised_waep": "OptionsExercisesInPeriodWeightedAverageExercisePrice$",
    "forfeited_waep": "OptionsForfeituresInPeriodWeightedAverageExercisePrice$",
    "exercised": "(OptionsExercisesInPeriod|StockIssuedDuringPeriodSharesStockOptionsExercised)$",
    "forfeited": "OptionsForfeituresInPeriod$",
    "expired": "OptionsExpirationsInPeriod$",
    "forfeited_and_expired": "OptionsForfeituresAndExpirationsInPeriod(Gross)?$",
    "exercisable_number": "OptionsExercisableNumber$",
    "exercisable_waep": "OptionsExercisableWeightedAverageExercisePrice$",
    "remaining_term": r"OptionsOutstandingWeightedAverageRemainingContractualTerm\d?$",
}
UNIT_FIELDS = {
    "nonvested_number": "EquityInstrumentsOtherThanOptionsNonvestedNumber$",
    "nonvested_wagdfv": "EquityInstrumentsOtherThanOptionsNonvestedWeightedAverageGrantDateFairValue$",
    "granted": "EquityInstrumentsOtherThanOptionsGrantsInPeriod(Gross)?$",
    "vested": "EquityInstrumentsOtherThanOptionsVestedInPeriod$",
    "granted_wagdfv": "EquityInstrumentsOtherThanOptionsGrantsInPeriodWeightedAverageGrantDateFairValue$",
    "vested_wagdfv": "EquityInstrumentsOtherThanOptionsVestedInPeriodWeightedAverageGrantDateFairValue$",
    "forfeited_wagdfv": "EquityInstrumentsOtherThanOptionsForfeituresWeightedAverageGrantDateFairValue$",
    "forfeited": "EquityInstrumentsOtherThanOptionsForfeit(ed|ures)InPeriod$",
}
SHARED_FIELDS = {
    "volatility": "FairValueAssumptionsExpectedVolatilityRate$",
    "dividend_yield": "FairValueAssumptionsExpectedDividendRate$",
    "risk_free_rate": "FairValueAssumptionsRiskFreeInterestRate$",
    "expected_term": "FairValueAssumptionsExpectedTerm1?$",
    "vesting_period": "AwardVestingPeriod1?$",
    "vesting_anniversaries": "AnniversariesOfGrantDate$",
    "expiration_period": "AwardExpirationPeriod$",
    "expense_recognition_period": r"CompensationCostNotYetRecognizedPeriodForRecognition\d?$",
}
CORE = ("outstanding_number", "granted", "exercised", "forfeited", "expired", "forfeited_and_expired", "exercisable_number", "nonvested_number", "vested")


def concept_class(concept) -> Column:
    """(family, field) of a concept, or NULL. Unit concepts contain ``OtherThanOptions`` and end like option ones."""
    return _class_of_name(local_name(concept))


def _class_of_name(name: Column) -> Column:
    """``concept_class`` of a local name; every pattern reads it anew, so a caller has it in a column of its own."""
    pick = lambda family, table: [F.when(name.rlike(f"(?i){p}"), F.struct(F.lit(family).alias("family"), F.lit(f).alias("field"))) for f, p in table.items()]
    units = name.rlike("(?i)otherthanoptions")
    own = F.when(units, F.coalesce(*pick("rsu", UNIT_FIELDS))).otherwise(F.coalesce(*pick("option", OPTION_FIELDS)))
    return F.coalesce(own, *pick("shared", SHARED_FIELDS))


def is_plan_information(text) -> Column:
    """Whether a text block is the table of plans authorised, which is no award note."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"(?i)equity\s+compensation\s+plan\s+information")


def with_closing_counts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Filings with a share count at an instant near their report date; the others are not worth reading."""
    counts = facts.where(F.col("concept").rlike("(?i)(?:OptionsOutstandingNumber|NonvestedNumber)$") & F.col("period_instant").isNotNull()).select("filing", "period_instant")
    near = counts.join(filings, "filing").where(days_apart("period_instant", "period_of_report") <= 15).select("filing").distinct()
    return filings.join(near, "filing", "left_semi")


def families_first(rows: DataFrame, by: list[str]) -> DataFrame:
    """Buckets in reading order: option buckets before the others, then by award; adds turn (from 1)."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("family") != "option", "award", "plan")))


def flow_size(x) -> Column:
    """Size of a flow as it is printed: without its sign."""
    return F.abs(F.col(x) if isinstance(x, str) else x)


def period_choice(durations: DataFrame, by: list[str], report: str) -> DataFrame:
    """Per filing the current duration (the longest that ends near the report date) and the comparable prior one.

    Expects period_start, period_end and the report date; filings without a current duration drop out.
    """
    length = F.datediff("period_end", "period_start")
    spans = durations.select(*by, report, "period_start", "period_end", length.alias("days")).where("days between 20 and 400").distinct()
    current = spans.where(days_apart("period_end", report) <= 15).groupBy(*by).agg(F.max_by(F.struct("period_start", "period_end", "days"), F.struct("days", "period_end")).alias("c"))
    current = current.select(*by, F.col("c.period_start").alias("cur_start"), F.col("c.period_end").alias("cur_end"), F.col("c.days").alias("cur_days"))
    near = days_apart("period_end", "cur_start")
    fits = (near <= 15) & (F.abs(F.col("days") - F.col("cur_days")) <= F.greatest(F.lit(30), F.floor(F.col("cur_days") / 5)))
    prior = spans.join(current, by).where(fits).groupBy(*by).agg(F.min_by(F.struct("period_start", "period_end"), F.struct(near, "period_start")).alias("p"))
    return current.join(prior, by, "left").select(*by, "cur_start", "cur_end", "cur_days", F.col("p.period_start").alias("pri_start"), F.col("p.period_end").alias("pri_end"))


def slot() -> Column:
    """Time slot of a fact beside its filing's periods; NULL if it belongs to none."""
    instant = F.when(days_apart("period_instant", "cur_end") <= 7, "closing").when(days_apart("period_instant", "cur_start") <= 10, "opening").when(days_apart("period_instant", "pri_start") <= 10, "prior_opening")
    current = (days_apart("period_end", "cur_end") <= 15) & (days_apart("period_start", "cur_start") <= 15)
    prior = (days_apart("period_end", "pri_end") <= 15) & (days_apart("period_start", "pri_start") <= 15)
    return F.when(F.col("period_instant").isNotNull(), instant).when(current, "current").when(prior, "prior")


def first_value(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    names = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__v"))
    return best.select(*key, *[F.col(f"__v.{n}").alias(n) for n in names])


def unanimous(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Keys all of whose values are one value, with their first row."""
    agreed = rows.groupBy(*key).agg(F.count_distinct(F.col(value).cast("string")).alias("__n")).where("__n = 1").drop("__n")
    return first_value(rows, key, order).join(agreed, key, "left_semi")


def _periods(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """``period_choice`` of the durations of facts, with the few of a filing beside each other: one grouping, no join of the table with itself."""
    span = F.struct("period_start", "period_end", F.datediff("period_end", "period_start").alias("days"))
    timed = facts.where("period_start is not null and period_end is not null and datediff(period_end, period_start) between 20 and 400")
    rows = timed.groupBy("filing").agg(F.collect_set(span).alias("spans")).join(filings, "filing")
    ends = F.filter("spans", lambda s: days_apart(s["period_end"], F.col("period_of_report")) <= 15)
    rows = once(rows, c=F.array_max(F.transform(ends, lambda s: F.struct(s["days"].alias("days"), s["period_end"].alias("end"), s["period_start"].alias("start"))))).where("c is not null")
    near = lambda s: days_apart(s["period_end"], F.col("c.start"))
    fits = F.filter("spans", lambda s: (near(s) <= 15) & (F.abs(s["days"] - F.col("c.days")) <= F.greatest(F.lit(30), F.floor(F.col("c.days") / 5))))
    prior = F.array_min(F.transform(fits, lambda s: F.struct(near(s).alias("near"), s["period_start"].alias("start"), s["period_end"].alias("end"))))
    rows = once(rows, p=prior)
    return rows.select("filing", F.col("c.start").alias("cur_start"), F.col("c.end").alias("cur_end"), F.col("p.start").alias("pri_start"), F.col("p.end").alias("pri_end"))


def slotted(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Long table (filing, family, award, plan, field, slot, value, unit_ref), first clean value or unanimous cohort value."""
    read = ["filing", "pos", "value", "numeric_value", "unit_ref", "period_start", "period_end", "period_instant"]
    named = once(facts.select(*read, "concept", "dims"), concept=local_name("concept"))
    own = once(named, concept=_class_of_name(F.col("concept"))).where("concept is not null").select(*read, "concept.family", "concept.field", "dims")
    ending = lambda end: F.get(F.map_values(F.map_filter("dims", lambda k, v: k.endswith(end))), F.lit(0))
    other = F.map_filter("dims", lambda k, v: ~k.endswith("AwardTypeAxis") & ~k.endswith("PlanNameAxis"))
    none = F.create_map().cast("map<string,string>")
    own = once(own, dims=F.coalesce("dims", none))
    own = once(own, award=F.coalesce(ending("AwardTypeAxis"), F.lit("")), plan=F.coalesce(ending("PlanNameAxis"), F.lit("")), extra=other).drop("dims")
    vesting = F.col("field").isin("vesting_period", "vesting_anniversaries")
    allowed = F.forall(F.map_entries("extra"), lambda e: e["key"].endswith("AwardDateAxis") | (vesting & e["key"].endswith("RangeAxis") & e["value"].endswith("MaximumMember")))
    own = own.where((F.size("extra") == 0) | ((F.col("family") == "shared") & allowed)).withColumn("cohort", F.size("extra") > 0).drop("extra")
    value = F.coalesce(fact_number("numeric_value").cast("string"), F.col("value"))
    own = own.withColumn("value", value).drop("numeric_value").where("value is not null")
    own = once(own.join(_periods(facts, filings), "filing"), slot=slot()).where("slot is not null")
    key = ["filing", "family", "award", "plan", "field", "slot"]
    rows = own.select(*key, "value", "unit_ref", "pos", "cohort")
    of = lambda cond, c: F.when(cond, F.col(c))
    first = lambda cond: F.min_by(F.struct("value", "unit_ref", "pos"), of(cond, "pos"))
    cohort = F.col("cohort")
    best = rows.groupBy(*key).agg(first(~cohort).alias("clean"), first(cohort).alias("dated"), F.min(of(cohort, "value")).alias("low"), F.max(of(cohort, "value")).alias("high"))
    # A cohort's value counts where all cohorts agree and there is no clean one.
    chosen = F.coalesce("clean", F.when(F.col("low") == F.col("high"), F.col("dated")))
    return best.withColumn("v", chosen).where("v is not null").select(*key, "v.value", "v.unit_ref", "v.pos")


def merged(long: DataFrame) -> DataFrame:
    """Fold detail and shared buckets into the buckets that hold a roll-forward; a value that is there is never replaced.

    ``long`` is the table of ``slotted``; award and plan are empty texts where absent.
    """
    stems = {"EmployeeStockOptionMember": "StockOption", "StockOptionMember": "StockOption", "RestrictedStockUnitsRSUMember": "RestrictedStockUnit", "RestrictedStockUnitsMember": "RestrictedStockUnit", "RestrictedStockMember": "RestrictedStock", "PerformanceSharesMember": "PerformanceShare", "PerformanceShareUnitsMember": "PerformanceShare"}
    literal = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    families = {m: "option" if m in ("EmployeeStockOptionMember", "StockOptionMember") else "rsu" for m, (t, _) in AWARDS.items() if m in ("EmployeeStockOptionMember", "StockOptionMember") or t in ("RSU", "PSU", "RSP")}
    bucket, filing = Window.partitionBy("filing", "family", "award", "plan"), Window.partitionBy("filing")
    core = F.max(F.col("field").isin(*CORE)).over(bucket) & (F.col("family") != "shared")
    rows = long.withColumn("core", core)
    # The few buckets of a filing that hold a roll-forward, beside each of its rows: nothing is joined with itself.
    rows = rows.withColumn("targets", F.array_sort(F.collect_set(F.when(F.col("core"), F.struct("family", "award", "plan"))).over(filing)))
    member = local_name("award")
    rows = rows.withColumn("home", F.try_element_at(literal(families), member)).withColumn("stem", F.try_element_at(literal(stems), member))
    shared, tagged = F.col("family") == "shared", F.col("award") != ""

    def rank(t: Column) -> Column:
        one_of_family = F.size(F.filter("targets", lambda x: x["family"] == t["family"])) == 1
        same_award = F.col("award") == t["award"]
        same = same_award & (F.col("plan") == t["plan"])
        stem = F.col("stem").isNotNull() & F.contains(local_name(t["award"]), F.col("stem")) & ~((F.col("stem") == "RestrictedStock") & local_name(t["award"]).contains("RestrictedStockUnit"))
        detail = F.when((F.col("family") != t["family"]) | (tagged & ~F.col("home").eqNullSafe(F.col("family"))), None).when(same, 1).when(tagged & same_award, 2).when(one_of_family, 3)
        whole = F.when(~tagged & (F.col("plan") == ""), F.when((t["family"] == "option") & one_of_family, 1).when(F.size("targets") == 1, 2))
        return F.when(shared, whole.when(same, 1).when(tagged & same_award, 2).when(tagged & (F.col("home") == t["family"]) & one_of_family, 3).when(stem, 4)).otherwise(detail)

    met = F.filter(F.transform("targets", lambda t: F.struct(rank(t).alias("rank"), t.alias("to"))), lambda m: m["rank"].isNotNull())
    rows = rows.withColumn("met", F.when(~F.col("core"), met)).withColumn("best", F.array_min(F.transform("met", lambda m: m["rank"])))
    near = F.transform(F.filter("met", lambda m: m["rank"] == F.col("best")), lambda m: m["to"])
    own = F.array(F.struct("family", "award", "plan"))
    to = F.when(F.col("core"), own).when(F.col("best") == 4, near).otherwise(F.slice(near, 1, 1))
    source = F.when(F.col("core"), 0).when(shared, 2).otherwise(1)
    moved = rows.select("filing", "field", "slot", "value", "unit_ref", "pos", source.alias("source"), F.explode(to).alias("to"))
    moved = moved.select("filing", "to.family", "to.award", "to.plan", "field", "slot", "value", "unit_ref", "pos", "source")
    return first_value(moved, ["filing", "family", "award", "plan", "field", "slot"], ["source", "pos"]).drop("source")


def plan_rows(long: DataFrame) -> DataFrame:
    """Strict award rows: filing, kind, award, count_mn, strike, maturity_years, the largest three of each filing."""
    names = {"outstanding": ("outstanding_number", "closing"), "nonvested": ("nonvested_number", "closing"), "waep": ("outstanding_waep", "closing"), "wagdfv": ("nonvested_wagdfv", "closing"), "term": ("remaining_term", None), "vesting": ("vesting_period", None), "anniversaries": ("vesting_anniversaries", None), "recognition": ("expense_recognition_period", None)}
    at = lambda f, s: F.max(F.when((F.col("field") == f) & (F.col("slot") == s if s else F.col("slot").isin("current", "closing")), F.col("value")))
    wide = long.groupBy("filing", "family", "award", "plan").agg(*[at(f, s).alias(k) for k, (f, s) in names.items()])
    unit = F.col("family") == "rsu"
    count = F.when(unit, fact_number("nonvested")).otherwise(fact_number("outstanding"))
    vesting = F.coalesce(duration_years("vesting"), fact_number("anniversaries"))
    maturity = F.when(unit, F.coalesce(vesting, duration_years("recognition"))).otherwise(F.coalesce(duration_years("term"), vesting))
    rows = wide.where("family <> 'shared'").select("filing", F.when(unit, "rsu").otherwise("option").alias("kind"), "award", "plan", (count / 1e6).alias("count_mn"), F.when(unit, fact_number("wagdfv")).otherwise(fact_number("waep")).alias("strike"), maturity.alias("maturity_years")).where("count_mn > 0")
    order = Window.partitionBy("filing").orderBy(F.desc("count_mn"), "kind", "award", "plan")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


def plan_rows_of(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """The whole way from facts to rows."""
    return reduce(lambda df, f: f(df), (merged, plan_rows), slotted(facts, filings))
