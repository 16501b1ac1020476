"""Rules for operating-margin judgements: ordered checks of which only the first failure surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsheet.functions.coerce import comp_margin, comp_revenue, once

#: Limits of a judgement.
LOW, HIGH = -0.05, 0.60
ANCHOR_CAP, NEGATIVE_EPS_SHARE, DISTORTED, FLOOR_SHARE = 1.5, 0.6, 0.05, 0.3
BAND, SCALE_LOW, SCALE_HIGH = 0.10, 0.3, 3.0
CLASSES = ("FAST_GROWER", "STALWART", "SLOW_GROWER", "CYCLICAL", "TURNAROUND", "ASSET_PLAY")
CONFIDENCE = ("high", "medium", "low")


def effective_anchor(*anchors) -> Column:
    """The highest anchor there is."""
    return F.greatest(*anchors)


def ttm_revenue(history: Column) -> Column:
    """Revenue of the first period named TTM, else of the first period; ``history`` is an array of (period, revenue)."""
    named = F.filter(history, lambda h: F.contains(F.lower(h["period"]), F.lit("ttm")))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(history, F.lit(1)))["revenue"]


#: What ``judged`` takes of each row; eps and comps are arrays.
INPUTS = ("target", "classification", "confidence", "us_anchor", "global_anchor", "mature_anchor", "past_average", "eps", "driver", "comps", "subject_revenue", "rationale")


def judged(rows: DataFrame, **given: Column) -> DataFrame:
    """``rows`` with error: the code of the first rule that a judgement breaks, NULL if it stands. ``given`` has INPUTS.

    Inputs and what the rules share of them are evaluated once a row, before the rules that name them.
    """
    own = once(rows, **{f"__{name}": given[name] for name in INPUTS})
    c = {name: F.col(f"__{name}") for name in INPUTS}
    eps = F.filter(c["eps"], lambda e: e.isNotNull())
    margins = F.filter(F.transform(c["comps"], comp_margin), lambda m: m.isNotNull())
    revenues = F.filter(F.transform(c["comps"], comp_revenue), lambda r: r.isNotNull())
    own = once(own, __anchor=effective_anchor(c["us_anchor"], c["global_anchor"], c["mature_anchor"]), __eps_given=eps, __margins=margins, __revenues=revenues)
    target, kind, anchor = c["target"], c["classification"], F.col("__anchor")
    negative = (F.size("__eps_given") > 0) & F.forall("__eps_given", lambda e: e < 0)
    scaled = F.exists("__revenues", lambda r: ~F.try_divide(r, F.col("__subject_revenue")).between(SCALE_LOW, SCALE_HIGH))
    own = once(own, __negative=negative, __scaled=scaled, __low=F.array_min("__margins"), __high=F.array_max("__margins"))
    rules = (
        ("missing_field", target.isNull() | kind.isNull() | c["confidence"].isNull() | c["rationale"].isNull()),
        ("classification", ~kind.isin(*CLASSES)),
        ("confidence", ~c["confidence"].isin(*CONFIDENCE)),
        ("range", ~target.between(LOW, HIGH)),
        ("anchor_cap", (anchor > 0) & (target > anchor * ANCHOR_CAP)),
        ("negative_eps", F.col("__negative") & (anchor > 0) & (target > NEGATIVE_EPS_SHARE * anchor)),
        ("distorted_anchor", (c["us_anchor"] < DISTORTED) & (kind == "FAST_GROWER") & (target < FLOOR_SHARE * c["mature_anchor"])),
        ("asset_play_driver", (kind == "ASSET_PLAY") & c["driver"]),
        ("asset_play_average", (kind == "ASSET_PLAY") & (c["past_average"].isNull() | (F.abs(target - c["past_average"]) > 1e-6))),
        ("comp_band", ~target.between(F.col("__low") - BAND, F.col("__high") + BAND)),
        ("comp_scale", (c["subject_revenue"] > 0) & F.col("__scaled")),
        ("rationale", F.trim(c["rationale"]) == ""),
    )
    error = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules])
    return once(own, error=error).select(*[F.col(f"`{n}`") for n in rows.columns if n != "error"], "error")
