"""Labels and rows paired by a fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from finsheet.operators import realign

PAGE = ["Assets", "Lease assets (note 3) 1,234 1,100", "Buildings: 500 480", "Lease-assets 77 (12)", "Deferred tax assets - -", "Plant, property & equipment 9,000", "Goodwill 10", "Inventories 20", "Cash 30"]


def frames(spark, labels):
    a = spark.createDataFrame([("d", i, x) for i, x in enumerate(labels)], "doc string, pos int, label string")
    return a, spark.createDataFrame([("d", i, x) for i, x in enumerate(PAGE)], "doc string, line_no int, text string").repartition(3)


def test_repeated_labels_meet_their_own_rows(spark):
    labels = ["Lease assets", "LEASE ASSETS", "plant property equipment", "Buildings", "Cash", "", None, "abc", "uildings"]
    out = {r.pos: (r.line_no, r.numbers) for r in realign.pair(*frames(spark, labels), "doc").collect()}
    assert out == {0: (1, []), 1: (3, [77.0, -12.0]), 2: (5, [9000.0]), 3: (None, None), 4: (8, [30.0]), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_documents_without_lines_keep_their_labels(spark):
    labels, lines = frames(spark, ["Cash"])
    out = realign.pair(labels, lines.limit(0), "doc").collect()
    assert [(r.pos, r.line_no) for r in out] == [(0, None)]


def test_values_are_replaced_only_where_many_are_contradicted(spark):
    labels = ["Buildings", "Lease assets", "Plant property equipment", "Goodwill", "Inventories", "Cash"]
    shifted, right = [77.0, 9000.0, 10.0, 20.0, 30.0, 0.0], [500.0, 77.0, 9000.0, 10.0, 21.0, 30.0]
    a, lines = frames(spark, labels)
    for given, want, n in ((shifted, [500.0, 77.0, 9000.0, 10.0, 20.0, 30.0], 6), (right, right, 0)):
        items = spark.createDataFrame([("d", i, label, v) for i, (label, v) in enumerate(zip(labels, given, strict=True))], "doc string, pos int, label string, value double")
        out = sorted(realign.repaired(items, realign.pair(a, lines, "doc"), "doc", "value").collect(), key=lambda r: r.pos)
        assert [r.value for r in out] == want and sum(r.replaced for r in out) == n
    old = realign.repaired(items.withColumn("value", F.lit(-5.0)), realign.pair(a, lines, "doc"), "doc", "value", F.lit(True))
    assert {r.pos: r.value for r in old.collect()}[0] == 480.0
