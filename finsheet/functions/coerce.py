"""Number, unit and percent coercions: Column -> Column, each with its own idea of what is missing.

They differ on purpose (what a dash means, whether a comma groups or separates, whether a failure is NULL, 0 or the
text itself), so a caller picks one by name and none stands in for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
FR = r"^-?\d{1,3}([  ]\d{3})+(,\d+)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the named columns (replacing its own), each evaluated once a row however often later steps name it.

    A generator of one row stands between them and what follows, so the optimizer copies no long expression into
    filters and projections.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(x: Column, body) -> Column:
    """``body`` of ``x``, which is evaluated once however often ``body`` names it; inside lambdas nothing else shares a value."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def half_even(x: Column, places: int) -> Column:
    """A double rounded half to even as it is stored, as SQL engines do; ``bround`` rounds its shortest decimal form instead.

    271866.525 is stored as a little more, so two places make it .53 here and .52 there.
    """
    scaled = x * (10.0**places)
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / (10.0**places) + 0.0).otherwise(x)  # no negative zero


def real(x) -> Column:
    """Text to a finite double: commas dropped, the blank words and anything unreadable NULL.

    The text is named once, so that a caller may use the result several times; a blank word is unreadable anyway.
    """
    v = F.regexp_replace(F.trim(_c(x).cast("string")), ",", "").try_cast("double")
    return F.nanvl(v + v * 0, F.lit(None).cast("double"))


def storable(x) -> Column:
    """Plain numeric text to double; grouped or decorated text is NULL."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def storable_int(x) -> Column:
    return F.trim(_c(x).cast("string")).try_cast("double").try_cast("int")


def storable_bool(x) -> Column:
    """true/yes/y/1 and false/no/n/0, anything else NULL."""
    s = F.lower(F.trim(_c(x).cast("string")))
    return F.when(s.isin("true", "yes", "y", "1"), True).when(s.isin("false", "no", "n", "0"), False)


def number_or_zero(x) -> Column:
    """Plain numeric text to double, everything else 0."""
    return F.coalesce(storable(x), F.lit(0.0))


def fact_number(x) -> Column:
    """Fact value to double; NaN is NULL."""
    v = _c(x).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def plain_number(s: Column) -> Column:
    """One number as text to canonical digits: US grouping and French grouping with a decimal comma."""
    t = F.trim(s)
    return F.when(t.rlike(US), F.regexp_replace(t, ",", "")).when(t.rlike(FR), F.regexp_replace(F.regexp_replace(t, "[  ]", ""), ",", ".")).otherwise(F.when(t.rlike(r"^-?\d+,\d{1,2}$"), F.regexp_replace(t, ",", ".")).otherwise(t))


def signs_folded(x) -> Column:
    """Runs of signs become one: a plus beside another sign goes, two minuses are a plus."""
    s = _c(x)
    for _ in range(2):
        for run, sign in ((r"\+\s*(?=[+-])", ""), (r"-\s*-", "+"), (r"-\s*\+", "-")):
            s = F.regexp_replace(s, run, sign)
    return s


#: An amount in a text of JSON, and two or more of them with signs between, from what opens a value to what ends it.
_AMOUNT = r"[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?"
_SUM = rf"(?<=[:\[,]\s{{0,8}})([-+]?\s*{_AMOUNT}(?:\s*[-+][-+\s]*{_AMOUNT})+)(?=\s*(?:[,\]}}]|$))"


def json_sums(x) -> Column:
    """Text of JSON in which sums such as ``845 + 5,829 - 3`` are what they come to; what stands inside strings stays."""
    parts = F.regexp_extract_all(_c(x), F.lit(r'("(?:[^"\\]++|\\.)*+"|[^"]+|")'), F.lit(1))

    def total(chain: Column) -> Column:
        terms = F.regexp_extract_all(signs_folded(chain), F.lit(rf"([-+]?\s*{_AMOUNT})"), F.lit(1))
        value = F.aggregate(terms, F.lit(0.0), lambda held, t: held + F.regexp_replace(t, r"[\s,+]", "").try_cast("double"))
        return bound(value, lambda v: F.when((v == F.floor(v)) & (F.abs(v) < 9e15), v.cast("long").cast("string")).otherwise(v.cast("string")))

    def outside(part: Column) -> Column:
        joined = lambda sums: F.array_join(F.transform(F.arrays_zip(F.split(part, _SUM).alias("r"), F.concat(F.transform(sums, total), F.array(F.lit(""))).alias("s")), lambda z: F.concat(z["r"], z["s"])), "")
        return bound(F.regexp_extract_all(part, F.lit(_SUM), F.lit(1)), lambda sums: F.when(F.size(sums) == 0, part).otherwise(joined(sums)))

    return F.when(_c(x).isNotNull(), F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(outside(p))), ""))


def tally_number(x) -> Column:
    """Printed amount to double for a tally: currency signs dropped, ``a + b - c`` chains added up, missing is 0."""
    s = F.trim(F.regexp_replace(_c(x).cast("string"), "[$€]", ""))
    terms = F.regexp_extract_all(signs_folded(s), F.lit(r"([+-]?\s*\d[\d,.  ]*)"), F.lit(1))
    numbers = F.transform(terms, lambda t: plain_number(F.regexp_replace(F.regexp_replace(F.trim(t), r"^([+-])\s*", "$1"), r"^\+", "")).try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when(s.isNull() | s.isin("", "-", "—"), 0.0).otherwise(F.coalesce(plain_number(s).try_cast("double"), F.when(s.rlike(r"^[\d\s+\-.,  ]+$"), total), F.lit(0.0)))


def tally_warning(x) -> Column:
    """What ``tally_number`` could not read, or NULL."""
    s = F.trim(F.regexp_replace(_c(x).cast("string"), "[$€]", ""))
    readable = s.isNull() | s.isin("", "-", "—") | s.rlike(r"^[\d\s+\-.,  ]*\d[\d\s+\-.,  ]*$")
    return F.when(~readable, F.concat(F.lit("unreadable amount: "), s))


def cell_number(x) -> Column:
    """Table cell to double: full US or French number, ``(x)`` negative, a dash 0; lists such as ``3, 9`` are NULL."""
    s = F.trim(F.regexp_replace(_c(x).cast("string"), "[$€]", ""))
    inner = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    sign = F.when(s.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)
    return F.when(s.isin("-", "—", "–"), 0.0).when(inner.rlike(US) | inner.rlike(FR) | inner.rlike(r"^-?\d+(\.\d+)?$"), sign * plain_number(inner).try_cast("double"))


def text_number(x) -> Column:
    """Number token to double, ``(x)`` negative, else NULL."""
    s = F.trim(_c(x).cast("string"))
    inner = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "$1"), ",", "")
    return F.when(s.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0) * inner.try_cast("double")


def word_number(x) -> Column:
    """Unsigned number of one printed word; percentages and words over 15 characters are NULL."""
    s = F.regexp_replace(_c(x).cast("string"), r"[$€£(),;:*†]", "")
    return F.when((F.length(s) <= 15) & ~s.contains("%"), F.abs(s.try_cast("double")))


def page_number(x) -> Column:
    """Printed number of a page, US or French, ``(x)`` negative, else NULL."""
    s = F.trim(_c(x).cast("string"))
    inner = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    return F.when(s.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0) * plain_number(inner).try_cast("double")


def millions(x, units) -> Column:
    """Amount to millions by its unit label; an unknown or missing label means single units."""
    label = F.lower(F.trim(F.coalesce(_c(units), F.lit(""))))
    unit = F.when(label.isin("millions", "million", "mn", "m", "mln"), 1.0).when(label.isin("thousands", "thousand", "k", "000s", "'000"), 1_000.0).otherwise(1_000_000.0)
    return real(x) / unit


def duration_years(x) -> Column:
    """ISO duration or plain number to years, 4 places; nothing positive is NULL."""
    s = F.upper(F.trim(_c(x).cast("string")))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(s, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    years = part("Y") + part("M") / 12.0 + part("D") / 365.0
    iso = F.when(s.rlike(r"^P(\d+(\.\d+)?Y)?(\d+(\.\d+)?M)?(\d+(\.\d+)?D)?$") & (years > 0), F.bround(years, 4))
    return F.coalesce(F.bround(fact_number(s), 4), iso)


def percent(x, unit) -> Column:
    """Fraction facts (unit ``pure``, at most 1.5) to percent, 6 places."""
    v = fact_number(x)
    return F.bround(F.when((F.lower(F.coalesce(_c(unit), F.lit(""))) == "pure") & (F.abs(v) <= 1.5), v * 100.0).otherwise(v), 6)


def comp_revenue(x) -> Column:
    """Revenue of a comparable such as ``~$2.4B revenue`` in millions, or NULL."""
    pattern = r"~?\$(\d+(?:\.\d+)?)\s*([BbMm])"
    v = F.nullif(F.regexp_extract(_c(x), pattern, 1), F.lit("")).try_cast("double")
    return F.when(F.lower(F.regexp_extract(_c(x), pattern, 2)) == "b", v * 1000).otherwise(v)


def comp_margin(x) -> Column:
    """Margin of a comparable such as ``~15% margin`` as a fraction, its revenue token taken out first."""
    rest = F.regexp_replace(_c(x), r"~?\$(\d+(?:\.\d+)?)\s*([BbMm])", "")
    return F.nullif(F.regexp_extract(rest, r"~(-?\d+(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double") / 100


def truthy(*columns) -> Column:
    """First value that is neither NULL nor 0, else 0."""
    return F.coalesce(*[F.nullif(_c(c), F.lit(0)) for c in columns], F.lit(0))
