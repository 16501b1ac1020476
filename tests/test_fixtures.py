"""Worked cases of the operators: plans, roll-forwards, facts, margins, coercions, mappings, forecasts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finsheet.functions import coerce, dates, maps, statement, text
from finsheet.operators import approx, facts, filings, forecast, margin, plans, sheet

PLAN = "filing string, plan_type string, is_nil_cost boolean, units_label string, closing_balance double, weighted_avg_exercise_price double, weighted_avg_grant_date_fair_value double, weighted_avg_remaining_contractual_life_years double, vesting_period_years double"


def one(spark, column, **values):
    """Value of a column expression over one row of strings."""
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string")
    return df.select(column.alias("v")).first().v


def test_plans_to_rows(spark):
    rows = [
        ("A", "RSU", True, None, 151574000.0, None, 189.75, None, None), ("N", "ESPP", False, None, None, None, None, None, None), ("N", "RSU", True, None, 10700000.0, None, 94.29, None, None),
        ("N", "ESOP", False, None, 75100000.0, 97.99, None, 5.4, 4.0), ("E", "ESOP", None, None, 5e6, 10.0, None, None, None), ("E", "RSU", True, "thousands", 5000.0, None, 0.0, -2.0, None), ("E", "ESOP", False, None, 5e6, -1.0, None, None, None),
    ]
    out = plans.top_plans(plans.sanitise(plans.classify(spark.createDataFrame(rows, PLAN))), ["filing"], ["strike"]).orderBy("filing", "rank").collect()
    assert [(r.filing, round(r.count_mn, 6), r.strike, r.maturity_years, r.kind) for r in out] == [("A", 151.574, 189.75, 4.0, "rsu"), ("E", 5.0, 0.1, 4.0, "rsu"), ("N", 75.1, 97.99, 5.4, "option"), ("N", 10.7, 94.29, 4.0, "rsu")]


def test_strict_rows_invent_nothing(spark):
    schema = PLAN + ", weighted_avg_expense_recognition_years double"
    r = plans.strict(spark.createDataFrame([("A", "RSU", True, None, 151574000.0, None, None, None, None, 2.5)], schema)).first()
    assert (r.strike, r.strike_field, r.maturity_years, r.maturity_field) == (None, None, 2.5, "weighted_avg_expense_recognition_years")


@pytest.mark.parametrize(
    ("row", "ok"),
    [((900.0, 250.0, 120.0, 30.0, None, None, 1000.0), True), ((900.0, 250.0, 0.0, 30.0, 120.0, None, 1000.0), True), ((900.0, 250.0, 120.0, 20.0, None, None, 1000.0), True), ((900.0, 250.0, 120.0, 0.0, None, None, 1000.0), False), ((None, 1.0, 1.0, 1.0, None, None, 5.0), None)],
)
def test_rollforward(spark, row, ok):
    df = spark.createDataFrame([row], "opening double, granted double, exercised double, lapsed double, vested double, settled double, closing double")
    gap = plans.rollforward_gap("opening", "granted", "exercised", "lapsed", "closing", "vested", "settled")
    assert df.select(plans.rollforward_ok(gap, "closing").alias("v")).first().v == ok


O, R = {"AwardTypeAxis": "us-gaap:EmployeeStockOptionMember"}, {"AwardTypeAxis": "us-gaap:RestrictedStockUnitsRSUMember"}


def fact_rows(second_cohort="P3Y"):
    d = dt.date
    instant, year = (None, None), (d(2025, 1, 1), d(2025, 12, 31))
    own = [
        ("OptionsOutstandingNumber", "1000000", instant, d(2025, 12, 31), O), ("OptionsOutstandingNumber", "900000", instant, d(2024, 12, 31), O), ("OptionsGrantsInPeriodGross", "250000", year, None, O),
        ("OptionsExercisesInPeriod", "-120000", year, None, O), ("OptionsForfeituresInPeriod", "30000", year, None, O), ("OptionsOutstandingWeightedAverageExercisePrice", "42.5", instant, d(2025, 12, 31), O),
        ("OptionsOutstandingWeightedAverageRemainingContractualTerm2", "P5Y6M", year, None, O), ("OptionsOutstandingNumber", "999999", instant, d(2025, 12, 31), O), ("OptionsOutstandingNumber", "77", instant, d(2023, 6, 30), O),
        ("EquityInstrumentsOtherThanOptionsNonvestedNumber", "2000000", instant, d(2025, 12, 31), R), ("EquityInstrumentsOtherThanOptionsNonvestedNumber", "1500000", instant, d(2024, 12, 31), R),
        ("EquityInstrumentsOtherThanOptionsNonvestedWeightedAverageGrantDateFairValue", "80", instant, d(2025, 12, 31), R), ("AwardVestingPeriod1", "P3Y", year, None, R | {"AwardDateAxis": "c1"}), ("AwardVestingPeriod1", second_cohort, year, None, R | {"AwardDateAxis": "c2"}),
        ("AwardVestingPeriod1", "P1Y", year, None, O | {"RangeAxis": "MinimumMember"}),
    ]
    return [("X", i, "us-gaap:ShareBasedCompensationArrangementByShareBasedPaymentAward" + c, v, float(v) if v.lstrip("-").replace(".", "").isdigit() else None, "shares", s, e, at, dims) for i, (c, v, (s, e), at, dims) in enumerate(own)]


FACT = "filing string, pos long, concept string, value string, numeric_value double, unit_ref string, period_start date, period_end date, period_instant date, dims map<string,string>"


@pytest.mark.parametrize(("cohort", "maturity"), [("P3Y", 3.0), ("P4Y", None)])
def test_facts_to_strict_rows(spark, cohort, maturity):
    filing = spark.createDataFrame([("X", dt.date(2025, 12, 31))], "filing string, period_of_report date")
    rows = facts.plan_rows_of(spark.createDataFrame(fact_rows(cohort), FACT), filing).orderBy("rank").collect()
    assert [(r.count_mn, r.strike, r.maturity_years, r.kind) for r in rows] == [(2.0, 80.0, maturity, "rsu"), (1.0, 42.5, 5.5, "option")]


def test_filing_without_a_current_period_is_rejected(spark):
    filing = spark.createDataFrame([("X", dt.date(2026, 6, 30))], "filing string, period_of_report date")
    assert facts.plan_rows_of(spark.createDataFrame(fact_rows(), FACT), filing).count() == 0


BASE = {"target": 0.20, "kind": "FAST_GROWER", "comps": ["Alnylam ~$2.4B revenue ~15% margin", "Neurocrine ~$2.3B revenue ~25% margin"]}


@pytest.mark.parametrize(("change", "error"), [({}, None), ({"target": 0.0108}, "distorted_anchor"), ({"comps": [*BASE["comps"], "Gilead ~$24.7B revenue ~30% margin"]}, "comp_scale"), ({"target": 0.01}, "distorted_anchor"), ({"target": 0.7}, "range")])
def test_margin_rules(spark, change, error):
    j = BASE | change
    lit = F.lit
    given = {"target": lit(j["target"]), "classification": lit(j["kind"]), "confidence": lit("medium"), "us_anchor": lit(0.0108), "global_anchor": lit(-0.0043), "mature_anchor": lit(0.295), "past_average": lit(-0.49)}
    given |= {"eps": F.array(*[lit(x) for x in (-1.35, -0.60, -0.05, 0.55)]), "driver": lit(True), "comps": F.array(*[lit(c) for c in j["comps"]]), "subject_revenue": lit(1058.2), "rationale": lit("because")}
    assert margin.judged(spark.range(1), **given).first().error == error


@pytest.mark.parametrize(("raw", "number"), [("12,470", 12470), ("1 013,5", 1013.5), ("845 + 5 829", 6674), ("532 + -34292", -33760), ("—", 0), ("n.a.", 0), (None, 0), ("$ 12", 12)])
def test_tally_numbers(spark, raw, number):
    assert one(spark, coerce.tally_number("x"), x=raw) == number


@pytest.mark.parametrize(("raw", "years"), [("P4Y6M", 4.5), ("P365D", 1.0), ("5.5", 5.5), ("P", None), (None, None)])
def test_durations(spark, raw, years):
    assert one(spark, coerce.duration_years("x"), x=raw) == years


@pytest.mark.parametrize(("raw", "value"), [("~$2.4B revenue", 2400), ("$950M", 950), ("none", None)])
def test_comparable_revenue(spark, raw, value):
    assert one(spark, coerce.comp_revenue(F.col("x")), x=raw) == value


@pytest.mark.parametrize(("token", "rung"), [("BBB+", "Baa2/BBB"), ("AAA", "A1/A+"), ("BBB-", "Baa2/BBB"), ("Aa3", "A1/A+"), ("CCC-", "Caa/CCC"), ("XX", None)])
def test_rating_rungs(spark, token, rung):
    assert one(spark, maps.snap_rating(F.col("x")), x=token) == rung


@pytest.mark.parametrize(("token", "agency"), [("Aaa", "Moody's"), ("AAA", "S&P"), ("C", "S&P/Moody's")])
def test_agencies(spark, token, agency):
    assert one(spark, maps.agency_of_rating(F.col("x")), x=token) == agency


@pytest.mark.parametrize(("raw", "name"), [("thermal  coal", "Coal & Related Energy"), ("REIT - Anything", "R.E.I.T."), ("", None)])
def test_industries(spark, raw, name):
    assert one(spark, approx.industry_by_rule(F.col("x"))[0], x=raw) == name


def test_rating_in_context(spark):
    texts = [(1, "A company. Its S&P credit rating is BBB+ with a stable outlook; AA once."), (2, "A note with no such thing"), (3, None), (4, "AA far before. " + "x " * 120 + "outlook: negative for the A rating")]
    got = {r.k: (r.token, r.outlook) for r in approx.ratings(spark.createDataFrame(texts, "k long, t string"), "k", "t").collect()}
    assert got == {1: ("BBB+", "Stable"), 4: ("A", "Negative")}



@pytest.mark.parametrize(
    ("name", "score"),
    [
        ("2025年度報告", 50), ("2025年報", 50), ("2025綜合財務報表", 52), ("2024年度報告", 43), ("2025財務年度中期報告", -27), ("2025季度業績公告", -52), ("Siemens Report FY2025", 22 + 8 + 18), ("AFS 2019", 30 - 24), ("Q3FY26 results", 25 - 45),
        ("presentation FY2025 English", -1), ("English 2026", 5), ("10-K 2025", 25 + 18), ("/pre_260512-1e", -35), ("Unaudited 2025", 35 + 18), ("FY'24 annual report", 30 + 11), ("download 1999 quarterly", -40 - 45),
    ],
)
def test_document_scores(spark, name, score):
    links = spark.createDataFrame([(name, "/a/x.pdf")], "anchor string, path string")
    assert filings.document_scores(links, "anchor", "path", 2026).first().score == score


def test_what_is_no_document_is_out(spark):
    links = spark.createDataFrame([("Annual report 2025", "/annual-report.html"), ("Annual report 2025", "/doc/7"), (None, None)], "anchor string, path string")
    assert [r.score for r in filings.document_scores(links, "anchor", "path", 2026).collect()] == [-100, 30 + 22 + 18, -100]


def test_carry_sections(spark):
    lines = [(1, "Assets", "assets", None, False), (2, "Current assets", None, "current", False), (3, "Cash", None, None, False), (4, "Total current assets", None, None, True), (5, "Plant", None, None, False), (6, "Liabilities", "liabilities", None, False), (7, "Payables", None, None, False)]
    df = spark.createDataFrame([("f", *x) for x in lines], "f string, pos int, label string, s string, c string, t boolean")
    out = {r.label: (r.side, r.section) for r in sheet.carry_sections(df, ["f"], "pos", F.col("s"), F.col("c"), F.col("t")).collect()}
    assert out == {"Assets": ("assets", None), "Current assets": ("assets", "current"), "Cash": ("assets", "current"), "Total current assets": ("assets", "current"), "Plant": ("assets", "non_current"), "Liabilities": ("liabilities", None), "Payables": ("liabilities", None)}


def test_forecast_months_and_half_even(spark):
    day = lambda y, m, d: int(dt.datetime(y, m, d, tzinfo=dt.UTC).timestamp() * 1000)
    points = spark.createDataFrame([("g", day(2025, 12, 31), "revenue", 3544.5, 1), ("g", day(2026, 12, 31), "revenue", 3545.5, 2), ("g", day(2026, 3, 31), "revenue", 1.0, 3)], "g string, ms long, series string, v double, pos int")
    assert forecast.year_end_month(points, ["g"], "ms", "pos").first().fye_month == 12
    rows = {r.period: r.revenue for r in forecast.pivot_periods(points, ["g"], "ms", "series", "v", ["revenue"]).collect()}
    assert rows == {"2025-12": 3544.0, "2026-12": 3546.0, "2026-03": 1.0}
    assert one(spark, dates.period_end("x"), x="2027-12") == "31/12/2027"


def test_state_blob(spark):
    html = 'x<script>window.__STATE__ = {"a":undefined,"b":[1,undefined]};</script>y'
    assert one(spark, forecast.state_blob(F.col("x")), x=html) == '{"a":null,"b":[1,null]}'


def test_statement_wording(spark):
    assert one(spark, statement.unit_label(F.col("x")), x="En milliers d'euros") == "in thousands"
    assert one(spark, statement.has_title(F.col("x"), ("balance sheet",)), x="average balance sheet data") is False
    assert one(spark, statement.is_multiyear(F.col("x")), x="2015 2016 2017 2018 2019") is True


def test_identifiers(spark):
    assert one(spark, text.cache_key(F.lit("a"), "x"), x="b") == __import__("hashlib").sha256(b"a\x00b").hexdigest()[:32]
    assert one(spark, text.fold("x"), x="L’Oréal Œuvre") == "l'oreal oeuvre"


def test_every_industry_word_is_in_normal_form(spark):
    df = spark.createDataFrame([(k,) for k in maps.INDUSTRY_WORDS], "x string")
    assert df.where(approx.industry_key(F.col("x")) != F.col("x")).count() == 0
