"""Crowded buckets of one group that have the same lead."""

from __future__ import annotations

from finsheet.llm.line_dedup import _by_leads


def test_a_line_stands_once_beside_a_lead(spark):
    """Three buckets of group 7 have lead 1; group 8 is another group, lead 2 another lead."""
    rows = [(b, k, 7, 1, n) for b, n, keys in ((10, 20, (1, 2, 3)), (11, 30, (2, 3, 4)), (12, 15, (3,))) for k in keys]
    rows += [(13, 3, 8, 1, 14), (14, 3, 7, 2, 13)]
    met = spark.createDataFrame(rows, "bucket long, key long, `group` long, low long, n long")
    got = _by_leads(met).collect()
    assert sorted((r.group, r.low, r.key, r.n) for r in got) == [(7, 1, 1, 20), (7, 1, 2, 30), (7, 1, 3, 30), (7, 1, 4, 30), (7, 2, 3, 13), (8, 1, 3, 14)]
    assert len({r.bucket for r in got}) == 3
