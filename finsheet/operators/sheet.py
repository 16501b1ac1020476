"""Balance sheets as long tables: tallies, diagnoses, guards, section carry-forward, units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.coerce import half_even

UNIT_FACTORS = {"thousands": 0.001, "millions": 1.0, "billions": 1000.0, "units": 1e-6}


def tolerance(n: Column, total: Column) -> Column:
    """One unit per non-zero entry, a thousandth of the total, one at least."""
    return F.greatest(n, F.abs(total) * 0.001, F.lit(1.0))


def tally(buckets: DataFrame, totals: DataFrame, by: list[str], amount: str, total: str) -> DataFrame:
    """Per side: the sum of its buckets against its printed total, the tolerance and whether it balances."""
    sums = buckets.groupBy(*by).agg(F.sum(F.coalesce(F.col(amount), F.lit(0.0))).alias("computed"), F.count_if(F.col(amount) != 0).cast("double").alias("n"))
    gap = F.col("computed") - F.col(total)
    return sums.join(totals, by).withColumn("gap", gap).withColumn("tolerance", tolerance(F.col("n"), F.col(total))).withColumn("balanced", F.abs("gap") <= F.col("tolerance"))


def side_entries(buckets: DataFrame, memo: DataFrame, counted: dict[str, list[str]]) -> DataFrame:
    """Every entry that a side's sum counts: its buckets, and the memo fields that ``counted`` names for the side.

    Both tables are (by..., side, section, bucket, amount), the memo table without side: a field may count on both.
    """
    sides = [memo.where(F.col("bucket").isin(fields)).withColumn("side", F.lit(side)) for side, fields in counted.items()]
    out = buckets
    for rows in sides:
        out = out.unionByName(rows)
    return out


def item_label(label) -> tuple[Column, Column, Column]:
    """(side, core, section) of an item label such as ``[ASSET] Inventories (current)``; what is not tagged is empty text."""
    text = F.col(label) if isinstance(label, str) else label
    side = F.regexp_extract(text, r"^\[(ASSET|LIABILITY|EQUITY)\]", 1)
    rest = F.when(side != "", F.regexp_replace(text, r"^\[[A-Z]+\]\s*", "")).otherwise(text)
    mark = F.regexp_extract(rest, r" \((current|non-current)\)$", 1)
    return side, F.trim(F.regexp_replace(rest, r" \((current|non-current)\)$", "")), F.replace(mark, F.lit("-"), F.lit("_"))


def bare_label(label) -> Column:
    """The core of an item label in lower case."""
    return F.lower(item_label(label)[1])


def _about(gap: Column) -> Column:
    """How far a value may lie from a gap that it explains: one per cent in whole units, one at least."""
    return F.greatest(F.lit(1.0), half_even(F.abs(gap) * 0.01, 0))


def nearest_bucket(buckets: DataFrame, gaps: DataFrame, by: list[str], bucket: str, amount: str) -> DataFrame:
    """For each surplus the specific bucket whose amount explains it; zero buckets and those for the rest explain nothing."""
    far = F.abs(F.col(amount) - F.col("gap"))
    own = buckets.where(~F.col(bucket).startswith("other_") & (F.col(amount) != 0))
    met = gaps.where("gap > 0").join(own, by).where(far <= _about(F.col("gap")))
    return met.groupBy(*by).agg(F.min_by(F.struct(F.col(bucket).alias("suspect"), F.col(amount).alias("suspect_amount")), F.struct(far, F.col(bucket))).alias("b")).select(*by, "b.suspect", "b.suspect_amount")


def contra_line(lines: DataFrame, gaps: DataFrame, by: list[str], side: str, label: str, value: str) -> DataFrame:
    """For each surplus the printed negative line of its size: (by, contra, contra_value). Lines without a side tag count on both sides."""
    tag, core, _ = item_label(label)
    far = F.abs(F.abs(F.col(value)) - F.col("gap"))
    keys = [c for c in by if c != side]
    met = gaps.where("gap > 0").join(lines.where(F.col(value) < 0).withColumns({"__tag": tag, "__core": core}), keys)
    met = met.where(((F.col("__tag") == "") | (F.col("__tag") == F.when(F.col(side) == "assets", "ASSET").otherwise("LIABILITY"))) & (far <= _about(F.col("gap"))))
    best = met.groupBy(*by).agg(F.min_by(F.struct(F.col("__core").alias("contra"), F.col(value).alias("contra_value")), F.struct(far, F.col("__core"), F.col(value))).alias("b"))
    return best.select(*by, "b.contra", "b.contra_value")


def diagnose(checked: DataFrame, suspects: DataFrame, contras: DataFrame, by: list[str]) -> DataFrame:
    """What is wrong with each side: a surplus is a double count, or a dropped negative line where one explains it and no
    bucket does; a shortfall is a line that was not mapped."""
    kind = F.when(F.col("balanced"), "balanced").when(F.col("gap") <= 0, "missing").when(F.col("suspect").isNull() & F.col("contra").isNotNull(), "missing_negative").otherwise("double_count")
    rows = checked.join(suspects, by, "left").join(contras, by, "left")
    return rows.withColumn("diagnosis", kind).withColumns({c: F.when(~F.col("balanced") & (F.col("suspect").isNull() | F.lit(not c.startswith("contra"))), F.col(c)) for c in ("suspect", "suspect_amount", "contra", "contra_value")})


def diagnosis_text(side: Column, gap: Column, kind: Column, name: Column) -> Column:
    """The diagnosis as a sentence with thousands separators."""
    size = F.format_number(F.abs(gap), 2)
    over = F.concat(F.lit("over by "), size)
    said = F.when(kind == "missing", F.concat(F.lit("under by "), size, F.lit("; a printed line is not mapped")))
    said = said.when(kind == "missing_negative", F.concat(over, F.lit("; the negative line '"), name, F.lit("' is left out")))
    said = said.when((kind == "double_count") & name.isNotNull(), F.concat(over, F.lit("; "), name, F.lit(" is counted twice"))).when(kind == "double_count", F.concat(over, F.lit("; a line is counted twice")))
    return F.concat(side, F.lit(": "), F.coalesce(said, F.lit("balanced")))


def overused(used: DataFrame, printed: DataFrame, key: list[str]) -> DataFrame:
    """Printed values that are used more often than they are printed."""
    a = used.groupBy(*key).agg(F.count(F.lit(1)).alias("n_used"))
    b = printed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_printed"))
    return a.join(b, key).where("n_used > n_printed")


#: Labels of current tax liabilities.
TAX_LABELS = ("taxes", "income taxes payable", "income tax payable")


def regroup_tax(buckets: DataFrame, lines: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Move current tax from ``other_current`` to ``deferred`` where the sums prove that it sits there; adds ``moved``.

    ``buckets`` has (by, deferred, other_current). The move takes place if ``deferred`` equals the current tax and deferred
    lines without the tax lines, and ``other_current`` holds at least the tax lines.
    """
    side, core, section = item_label(label)
    name = F.rtrim(F.regexp_replace(F.lower(core), r"[:\s]+$", ""))
    own = lines.withColumns({"__side": side, "__section": section, "__name": name}).where((F.col("__side") == "LIABILITY") & (F.col("__section") == "current") & (F.col(value) != 0))
    tax = F.sum(F.when(F.col("__name").isin(*TAX_LABELS), F.col(value)))
    like = F.sum(F.when(F.contains("__name", F.lit("tax")) | F.contains("__name", F.lit("deferred")), F.col(value)))
    sums = own.groupBy(*by).agg(tax.alias("__tax"), like.alias("__like"))
    fits = (F.abs(F.col("deferred") - (F.col("__like") - F.col("__tax"))) <= 0.01) & (F.col("other_current") >= F.col("__tax"))
    moved = F.when(F.coalesce(fits, F.lit(False)), F.col("__tax")).otherwise(0.0)
    rows = buckets.join(sums, by, "left").withColumn("moved", moved)
    return rows.withColumns({"deferred": F.col("deferred") + F.col("moved"), "other_current": F.col("other_current") - F.col("moved")}).drop("__tax", "__like")


def dumped(buckets: DataFrame, totals: DataFrame, by: list[str], bucket: str, amount: str, total: str, share: float = 0.6) -> DataFrame:
    """(by, bucket, share) of buckets for the rest that hold over 60 % of a positive total while no specific bucket is filled."""
    rest = F.col(bucket).startswith("other_")
    sums = buckets.groupBy(*by).agg(F.max(F.when(~rest & (F.coalesce(F.col(amount), F.lit(0.0)) != 0), True)).alias("__specific"))
    met = buckets.where(rest).join(sums.where("__specific is null").drop("__specific"), by).join(totals, by)
    return met.where((F.col(total) > 0) & (F.col(amount) > share * F.col(total))).select(*by, F.col(bucket).alias("bucket"), (F.col(amount) / F.col(total)).alias("share"))


def schema_faults(names: DataFrame, by: list[str], name: str, wanted: list[str]) -> DataFrame:
    """(by, missing, unexpected): what each result's field names lack and have beyond the wanted ones; exact results drop out."""
    own = names.groupBy(*by).agg(F.collect_set(name).alias("__own"))
    asked = F.array(*[F.lit(w) for w in wanted])
    rows = own.select(*by, F.array_sort(F.array_except(asked, "__own")).alias("missing"), F.array_sort(F.array_except("__own", asked)).alias("unexpected"))
    return rows.where((F.size("missing") > 0) | (F.size("unexpected") > 0))


#: Words of the lines that may back an equity-like bucket.
EQUITY_TERMS = {"preferred_stock": ("preferred",), "mezzanine_equity": ("mezzanine", "redeemable", "temporary equity", "preferred")}


def backed(buckets: DataFrame, lines: DataFrame, by: list[str], bucket: str, amount: str, label: str, value: str, terms: dict[str, tuple[str, ...]] = EQUITY_TERMS) -> DataFrame:
    """Zero every bucket of ``terms`` that no printed line with one of its words, nor all those lines together, equals."""
    low = F.lower(label)
    of = F.filter(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in terms.items()]), lambda n: n.isNotNull())
    own = lines.select(*by, F.explode(of).alias(bucket), F.col(value).alias("__v")).groupBy(*by, bucket).agg(F.collect_set("__v").alias("__values"), F.sum("__v").alias("__sum"))
    met = buckets.join(own, [*by, bucket], "left")
    ok = F.array_contains("__values", F.col(amount)) | (F.col("__sum") == F.col(amount))
    return met.withColumn(amount, F.when(F.col(bucket).isin(*terms) & ~F.coalesce(ok, F.lit(False)), 0.0).otherwise(F.col(amount))).drop("__values", "__sum")


def better_side(first: DataFrame, retry: DataFrame, by: list[str], gap: str) -> DataFrame:
    """Of two runs the side with the smaller gap; equal gaps keep the retry."""
    both = first.withColumn("run", F.lit(1)).unionByName(retry.withColumn("run", F.lit(2)))
    rest = [c for c in both.columns if c not in by]
    best = both.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(F.abs(gap), -F.col("run"))).alias("b"))
    return best.select(*by, *[F.col(f"b.{c}").alias(c) for c in rest])


def printed_first(printed: Column, extracted: Column) -> Column:
    return F.coalesce(printed, extracted)


def derived_liabilities(total_assets: Column, total_liabilities: Column, equity: Column) -> Column:
    """Liabilities as assets less equity where nothing is printed and equity lies between 0 and the assets."""
    return F.coalesce(total_liabilities, F.when((equity > 0) & (equity < total_assets), total_assets - equity))


def to_millions(amount: Column, unit: Column) -> tuple[Column, Column]:
    """(amount in millions, 3 places half-even, warning if the unit is not known)."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_FACTORS.items() for x in kv]), F.lower(F.trim(unit)))
    return F.bround(amount * F.coalesce(factor, F.lit(1e-6)), 3), F.when(factor.isNull(), F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("none"))))


def carry_sections(lines: DataFrame, by: list[str], order: str, side: Column, section: Column, total: Column) -> DataFrame:
    """Carry side and section headings down to the lines below them.

    ``side`` and ``section`` are the marker of a line or NULL; a new side forgets the section, and a line for which
    ``total`` holds ends the current section: the lines after it are non-current.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumns({"__side": side, "__section": section, "__total": F.coalesce(total, F.lit(False))})
    rows = rows.withColumn("side", F.last("__side", ignorenulls=True).over(upto))
    rows = rows.withColumn("__changed", F.when(F.col("__side").isNotNull() & ~F.col("__side").eqNullSafe(F.last("__side", ignorenulls=True).over(before)), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__changed").over(upto))
    inside = Window.partitionBy(*by, "__run").orderBy(order)
    after = F.lag(F.when(F.col("__total"), "non_current")).over(inside)
    mark = F.coalesce("__section", "__after")
    rows = rows.withColumn("__after", after).withColumn("section", F.last(mark, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("__side", "__section", "__total", "__changed", "__run", "__after")


def parents(lines: DataFrame, by: list[str], order: str, label: str, value: str, kept: dict[str, bool], most: int = 8) -> DataFrame:
    """Hierarchies of a parent line and the lines after it that add up to it: (by, parent, order, n_parts, keep_parent).

    Only lines whose bare label is in ``kept`` are parents, the first of each label in a sheet; ``kept`` says whether the parent
    or its parts stay. The fewest lines win whose sum comes within max(2, n) of the parent, before the sum runs past it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    ahead = F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(w.rowsBetween(1, most))
    upto = lambda k: F.aggregate(F.slice("__ahead", 1, k), F.lit(0.0), lambda a, v: a + v)
    tolerance_ = [F.lit(float(max(2, k))) for k in range(1, most + 1)]
    has = lambda k: F.size("__ahead") >= k
    hit = F.array_min(F.array(*[F.when(has(k) & (F.abs(upto(k) - F.col(value)) <= tolerance_[k - 1]), k) for k in range(1, most + 1)]))
    past = F.array_min(F.array(*[F.when(has(k) & (upto(k) > F.col(value) + tolerance_[k - 1]), k) for k in range(1, most + 1)]))
    rows = lines.withColumns({"__ahead": ahead, "parent": bare_label(label)})
    rows = rows.where(F.col("parent").isin(*kept)).withColumn("__first", F.min(order).over(Window.partitionBy(*by, "parent"))).where(F.col(order) == F.col("__first"))
    rows = rows.where(F.col(value) != 0).withColumns({"n_parts": hit, "__past": past}).where(F.col("n_parts").isNotNull() & (F.col("__past").isNull() | (F.col("__past") > F.col("n_parts"))))
    keep = F.try_element_at(F.create_map(*[F.lit(x) for kv in kept.items() for x in kv]), F.col("parent"))
    return rows.select(*by, "parent", order, F.col("n_parts").cast("long").alias("n_parts"), keep.alias("keep_parent"))


def debt(current: Column, long_term: Column) -> tuple[Column, Column, Column]:
    a, b = F.coalesce(current, F.lit(0.0)), F.coalesce(long_term, F.lit(0.0))
    return a, b, a + b


def chain_sum(text: Column) -> Column:
    """Sum of a chain of printed terms such as ``845 + 5829 - 3``."""
    terms = F.regexp_extract_all(F.regexp_replace(text, r"\+\s*-", "-"), F.lit(r"([+-]?\s*[\d.,]+)"), F.lit(1))
    return F.aggregate(F.transform(terms, lambda t: F.regexp_replace(t, r"[\s,]", "").try_cast("double")), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def independent_total(candidates: DataFrame, references: DataFrame, by: list[str], slack: float = 0.01) -> DataFrame:
    """First candidate that an independent reference agrees with, in candidate then reference order."""
    met = candidates.join(references, by).where(F.abs(F.col("candidate") - F.col("reference")) <= slack * F.abs("reference"))
    best = met.groupBy(*by).agg(F.min_by(F.struct("candidate", "reference"), F.struct("candidate_pos", "reference_pos")).alias("b"))
    return best.select(*by, "b.candidate", "b.reference")


def confirmed_total(candidates: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidate, reference, label): the first candidate that a reference confirms which rests on none of its facts.

    ``candidates`` has (by, pos, candidate, facts), ``references`` (by, pos, reference, n_lines, label, facts); facts is the set of
    printed values that a number was made of, so that nothing confirms itself. They agree within the tolerance of a tally of as
    many lines. Candidates and references are tried in the order of pos.
    """
    a = candidates.select(*by, F.col("pos").alias("__c"), "candidate", F.col("facts").alias("__cf"))
    b = references.select(*by, F.col("pos").alias("__r"), "reference", "n_lines", "label", F.col("facts").alias("__rf"))
    near = F.abs(F.col("candidate") - F.col("reference")) <= tolerance(F.col("n_lines").cast("double"), F.col("candidate"))
    met = a.join(b, by).where(near & ~F.arrays_overlap("__cf", "__rf"))
    best = met.groupBy(*by).agg(F.min_by(F.struct("candidate", "reference", "label"), F.struct("__c", "__r")).alias("b"))
    return best.select(*by, "b.*")


def liabilities_only(totals: DataFrame, equity: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """``totals`` (by, assets, liabilities) with the liabilities of a grand total taken apart: adds liabilities, warning.

    Where printed liabilities equal assets they hold equity too. They become assets less the first equity value (``equity``: by,
    pos, equity, facts) between none and all of the assets that a reference confirms; without one they stay, with a warning.
    """
    grand = totals.where((F.col("assets") != 0) & (F.col("assets") == F.col("liabilities"))).select(*by, "assets")
    tried = grand.join(equity, by).where((F.col("equity") > 0) & (F.col("equity") < F.col("assets")))
    tried = tried.select(*by, "pos", F.round(F.col("assets") - F.col("equity"), 3).alias("candidate"), F.array_union("facts", F.array(F.lit("assets"))).alias("facts"))
    sound = confirmed_total(tried, references, by)
    marked = totals.join(grand.select(*by, F.lit(True).alias("__grand")), by, "left").join(sound, by, "left")
    warning = F.when(F.col("candidate").isNotNull(), F.concat(F.lit("grand total taken apart, confirmed by "), "label")).when(F.col("__grand"), "grand total, no equity confirmed")
    return marked.withColumn("liabilities", F.coalesce("candidate", "liabilities")).withColumn("warning", warning).drop("__grand", "candidate", "reference", "label")


def final_values(tables: list[DataFrame], by: list[str]) -> DataFrame:
    """(by, values): the set of every non-zero number in any of the tables (by, amount), without signs and to four places."""
    every = reduce(DataFrame.unionByName, [t.select(*by, F.round(F.abs("amount"), 4).alias("v")) for t in tables])
    return every.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(F.col("v") != 0, F.col("v")))).alias("values"))


def pairwise_sums(left: Column, right: Column) -> Column:
    """Sums of two number arrays place by place, as far as both go."""
    return F.filter(F.zip_with(left, right, lambda a, b: a + b), lambda v: v.isNotNull())


def equity_candidates(printed: Column, of_page: Column, tagged: Column) -> Column:
    """Equity values to try, once each: the printed total, those of the page, tagged lines from the last up, then their sum."""
    total = F.when(F.size(tagged) > 0, F.array(F.aggregate(tagged, F.lit(0.0), lambda a, v: a + v))).otherwise(F.array().cast("array<double>"))
    every = F.concat(F.array(printed.cast("double")), of_page)
    every = F.concat(F.filter(every, lambda v: v.isNotNull() & (v != 0)), F.reverse(tagged), total)
    return F.array_distinct(every)
