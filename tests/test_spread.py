"""Costly reading of small tables, whose rows are dealt to all partitions; tasks of growing tables; classes of concepts against their patterns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from finsheet.functions import statement
from finsheet.operators import facts, report
from finsheet.plans import award_queries
from finsheet.plans.report_queries import report_tranches
from finsheet.plans.tables import dealt


def test_pages_of_one_file_are_read_in_all_partitions(spark):
    pages = spark.createDataFrame([("total assets 1,234\ntotal liabilities and equity 9,000\ntotal equity 4,000",), ("nothing",)], "text string").coalesce(1)
    read = statement.printed_totals(pages, "text")
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.assets or 0, r.liabilities or 0, r.equity or 0) for r in read.collect()) == [(0, 0, 0), (1234, 5000, 4000)]


def test_tranches_are_shuffled_once_and_joined_with_nothing(spark, sf):
    plan = report_tranches(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_facts_are_shuffled_only_by_filing(spark, sf):
    """Once for the facts and once for the periods, which read the same rows."""
    for query in (award_queries.dimensional_facts, award_queries.facts_to_rows):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        keys = {line.split("Exchange hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line}
        assert keys == {"filing"} and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning(")


def test_rows_are_dealt_to_more_tasks_as_their_table_is_read_in_more_parts(spark):
    rows = spark.range(100, numPartitions=3)
    assert dealt(rows, rows, "id").rdd.getNumPartitions() == 12 and dealt(rows.coalesce(1), rows.coalesce(1), "id").rdd.getNumPartitions() == 4


def test_last_runs_of_plans_with_and_without_a_name(spark):
    rows = [("f", i, p) for i, p in enumerate(["a", "a", None, "a", "b", "b", "a", "a", None])] + [("g", 1, "a"), ("g", 2, "a"), (None, 1, "a")]
    got = report.with_last_runs(spark.createDataFrame(rows, "filing string, pos int, plan string"), ["filing"], "plan", "pos").collect()
    assert sorted(tuple(r) for r in got) == sorted((f, i, p, *{("f", "a"): (7, 8), ("f", "b"): (5, 6), ("g", "a"): (1, 2)}[f, p]) for f, i, p in rows if f and p)


def test_concepts_are_classed_as_by_the_first_pattern_that_matches(spark):
    """Every ending of every concept, in several cases, is classed as by its pattern alone."""
    tables = {"rsu": facts.UNIT_FIELDS, "option": facts.OPTION_FIELDS, "shared": facts.SHARED_FIELDS}
    names = []
    for table in tables.values():
        for pattern in table.values():
            forms = [pattern.rstrip("$")]
            while any(re.search(r"\(|\\d|.\?", f) for f in forms):
                forms = [g for f in forms for g in _opened(f)]
            names += [prefix + case(f) for f in forms for prefix in ("us-gaap:", "x:OtherThanOptions") for case in (str, str.upper)]

    def plain(name):
        local = name.split(":")[-1]
        own = ["rsu"] if "otherthanoptions" in local.lower() else ["option"]
        return next(((family, field) for family in (*own, "shared") for field, p in tables[family].items() if re.search(p, local, re.I)), None)

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", facts.concept_class(F.col("n")).alias("c")).collect()
    assert len(names) > 100 and {r.n: r.c and tuple(r.c) for r in got} == {n: plain(n) for n in names}


def _opened(form):
    """The forms that a pattern's first group, digit or optional letter stands for."""
    m = re.search(r"\(([^()]*)\)(\??)|\\d(\??)|(.)\?", form)
    if not m:
        return [form]
    choices = m[1].split("|") if m[1] is not None else ["2"] if m[4] is None else [m[4]]
    optional = [""] if m[2] or m[3] or m[4] else []
    return [form[: m.start()] + c + form[m.end() :] for c in (*choices, *optional)]
