"""Which landed filing of a market to take: rule shapes over tables of filings and attachments, all companies at once.

A market's connector is a shape with its table of words or preferences below. Fetching is not part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that a title of a full annual report holds, and words that it must not hold.
ANNUAL_TITLES = {
    "cn": (("年度报告",), ("摘要", "取消", "更正", "补充", "英文", "(英文版)", "（英文版）", "已取消")),
    "hk": (("annual report",), ("summary", "interim", "circular")),
}
#: Words that rule an attachment out, and (words, points) that speak for it.
ATTACHMENT_WORDS = {
    "il": (
        ("q1", "q2", "q3", "1st quarter", "2nd quarter", "3rd quarter", "quarterly", "interim", "semiannual", "semi-annual", "presentation", "conference", "notice", "immediate report", "webcast", "esg", "press release", "summary"),
        ((("annual", "periodic", "yearly", "year ended", "31.12", "f20", "20-f", "10-k"), 60), (("financial statements", "consolidated financial", "financial report"), 40)),
    ),
    "my": (
        ("corporate governance", "cg report", "sustainability", "environmental", "esg", "circular", "notice of", "proxy", "agm", "minutes"),
        ((("financial statements", "financial statement", "audited", "consolidated financial"), 60), (("annual report", "integrated ar", "integrated annual", "annual & "), 30), (("part 1", "part i"), 5)),
    ),
}
#: Preferred formats, forms and report codes, best first.
FORMATS = {"dk": ("application/xhtml+xml", "application/pdf", "image/tiff", "image/tif"), "uk": ("application/pdf", "application/xhtml+xml"), "tw": ("AI1", "AIA", "AI3")}
FORMS = {"us": ("10-K", "10-Q"), "ca": ("40-F", "20-F", "10-K"), "jp": ("120",), "jp_interim": ("120", "160"), "kr": ("A001",)}
#: Terms of a financial exhibit.
FINANCIAL_TERMS = ("share-based", "stock-based compensation", "stock option", "consolidated statements", "independent auditor", "registered public accounting", "vesting", "notes to the consolidated")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def full_annual(title, market: str) -> Column:
    """Whether a title is that of a full annual report in its market."""
    low = F.lower(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    wanted, unwanted = ANNUAL_TITLES[market]
    return _any(low, wanted) & ~_any(low, unwanted)


def attachment_score(name, market: str) -> Column:
    """Points of an attachment by its name: -1000 for what is no PDF where that is asked, -100 for a ruled-out one."""
    low = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    if market == "id":
        return _statement_points(low)
    reject, hints = ATTACHMENT_WORDS[market]
    points = F.lit(0)
    for words, n in hints:
        points = points + F.when(_any(low, words), n).otherwise(0)
    if market == "il":
        points = points + F.when(low.rlike(r"20\d{2}"), 10).otherwise(0)
    score = F.when(_any(low, reject), -100).otherwise(points)
    return F.when(~low.endswith(".pdf"), -1000).otherwise(score) if market == "my" else score


def _statement_points(low: Column) -> Column:
    """Indonesian attachments: the issuer's audited statements before the exchange's template before annual-report parts."""
    template = low.rlike(r"financialstatement-\d{4}-tahunan")
    cover = low.startswith("surat") | _any(low, ("pengantar", "penjelasan"))
    own = _any(low, ("laporan keuangan", " lk ")) | low.startswith("lk ")
    rules = ((F.contains(low, F.lit("audited")), 60), (own, 55), (F.contains(low, F.lit("financial statement")) & ~template, 50), (_any(low, ("(english)", " english")), 15), (template, 25), (F.contains(low, F.lit("annualreport")), 5))
    points = F.lit(0)
    for holds, n in rules:
        points = points + F.when(holds, n).otherwise(0)
    return F.when(F.contains(low, F.lit("esg")), -100).when(cover, -50).otherwise(points)


def term_score(text, terms: tuple[str, ...] = FINANCIAL_TERMS) -> Column:
    """How often the terms occur in a text, all together."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    total = F.lit(0)
    for t in terms:
        total = total + F.regexp_count(low, F.lit(t))
    return total


def term_hits(text, terms: tuple[str, ...]) -> Column:
    """How many different terms occur in a text."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.size(F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]), lambda t: t.isNotNull()))


def one_of(rows: DataFrame, by: list[str], order: Column, name: str = "chosen") -> DataFrame:
    """The row of each group that is least in ``order``, as a struct of its other columns."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias(name)).select(*by, *[F.col(f"{name}.{c}").alias(c) for c in rest])


def best_format(rows: DataFrame, by: list[str], newest: str, kind: str, preference: tuple[str, ...], tie: str) -> DataFrame:
    """Of the newest publication of each company the document in the best format; unlisted formats come last."""
    at = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    place = F.when(at > 0, at).otherwise(len(preference) + 1)
    return one_of(rows, by, F.struct(F.col(newest).isNull(), (-F.unix_date(newest)).alias("age"), place.alias("place"), F.col(tie).alias("tie")))


def newest_of_forms(rows: DataFrame, by: list[str], form: str, forms: tuple[str, ...], filed: str, tie: str) -> DataFrame:
    """The newest filing among the forms; filings without a date come last."""
    return one_of(rows.where(F.col(form).isin(*forms)), by, F.struct(F.col(filed).isNull(), (-F.unix_date(filed)).alias("age"), F.col(tie).alias("tie")))


def newest_year(rows: DataFrame, by: list[str], year: str, current: int, back: int) -> DataFrame:
    """The rows of the newest year that has any, no more than ``back`` years ago."""
    inside = rows.where(F.col(year).between(current - back, current))
    top = inside.groupBy(*by).agg(F.max(year).alias(year))
    return inside.join(top, [*by, year], "left_semi")


def newest_release(rows: DataFrame, by: list[str], period_end: str, added: str, errors: str, floor: int) -> DataFrame:
    """The newest report, of equal periods the one added last and with the fewest errors; none if it ends before the floor year."""
    age = lambda c: F.coalesce(-F.unix_date(c), F.lit(2**31 - 1))
    best = one_of(rows, by, F.struct(age(period_end).alias("p"), age(added).alias("a"), F.coalesce(F.col(errors), F.lit(0)).alias("e")))
    return best.where(F.col(period_end).isNull() | (F.year(period_end) >= floor))


def best_or_parts(rows: DataFrame, by: list[str], score: str, part: str, tie: str, floor: int = 25) -> DataFrame:
    """One document if the best scores at least ``floor``, else the numbered parts in order, else the best; adds turn (from 1)."""
    ranked = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    group = Window.partitionBy(*by)
    ranked = ranked.withColumns({"__top": F.max(score).over(group), "__parts": F.count(part).over(group)})
    single = (F.col("__top") >= floor) | (F.col("__parts") == 0)
    kept = ranked.where(F.when(single, F.col("__i") == 1).otherwise(F.col(part).isNotNull()))
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce(F.col(part), F.lit(0)), tie))).drop("__i", "__top", "__parts")


def best_exhibit(rows: DataFrame, by: list[str], text: str, tie: str, terms: tuple[str, ...] = FINANCIAL_TERMS) -> DataFrame:
    """The exhibit in which the terms occur most often, of equal ones the longest."""
    scored = rows.withColumns({"score": term_score(text, terms), "length": F.length(F.coalesce(F.col(text), F.lit("")))})
    return one_of(scored, by, F.struct((-F.col("score")).alias("s"), (-F.col("length")).alias("l"), F.col(tie).alias("tie")))


def has_award_note(text) -> Column:
    """Whether a text has the note on awards: a price phrase, and granted beside another flow, in either order."""
    t = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+", " ")
    price = t.rlike(r"(?i)weighted[\s-]*average\s+(?:exercise\s+price|grant[\s-]*date\s+fair\s+value)")
    return price & t.rlike(r"(?i)\bgranted\b") & t.rlike(r"(?i)\b(?:exercised|forfeited|vested)\b")


def exhibits_to_append(rows: DataFrame, by: list[str], name: str, primary: str, text: str, pos: str, scanned: int = 30, most: int = 2) -> DataFrame:
    """Exhibits with the award note of those filings whose primary document lacks it: the first two among the first thirty pages."""
    noted = rows.withColumn("__note", has_award_note(text))
    lacking = noted.where(F.col(primary)).groupBy(*by).agg(F.max("__note").alias("__has")).where("not __has").select(*by)
    low = F.lower(name)
    pages = noted.where(~F.col(primary) & low.rlike(r"\.html?$") & ~low.rlike(r"^r\d+\.htm") & ~F.contains(low, F.lit("filingsummary"))).join(lacking, by, "left_semi")
    pages = pages.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).where(F.col("__i") <= scanned).where("__note")
    return pages.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).where(F.col("turn") <= most).drop("__i", "__note")


def name_stamp(name) -> Column:
    """Newest date stamp such as 20260331 in a file name or anchor, 0 without one."""
    found = F.regexp_extract_all(F.col(name) if isinstance(name, str) else name, F.lit(r"(?<!\d)(20\d{2}[01]\d[0-3]\d)(?!\d)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda s: s.cast("int"))), F.lit(0))


def ranked_results(rows: DataFrame, by: list[str], named: Column, deck: Column, name: str, year: str, score: str, tie: str) -> DataFrame:
    """Result documents in the order to try them: named ones that are no slides, newest stamp, newest year, best score."""
    tier = F.when(named & ~deck, 0).when(named, 1).otherwise(2)
    rows = rows.withColumns({"tier": tier, "stamp": name_stamp(name)})
    order = Window.partitionBy(*by).orderBy("tier", F.desc("stamp"), F.desc(F.coalesce(F.col(year), F.lit(0))), F.desc(score), tie)
    return rows.withColumn("turn", F.row_number().over(order))


def best_and_runner_up(rows: DataFrame, by: list[str], name: str, score: str) -> DataFrame:
    """(by, best, score, runner_up): each candidate once with its best score; the second best score, 0 without one."""
    once = rows.groupBy(*by, name).agg(F.max(score).alias("score"))
    ranked = once.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), name))).where("__i <= 2")
    out = ranked.groupBy(*by).agg(F.min_by(name, "__i").alias("best"), F.max("score").alias("score"), F.min(F.when(F.col("__i") == 2, F.col("score"))).alias("runner_up"))
    return out.na.fill(0, ["runner_up"])


def page_verified(status, text, ticker, tokens, title_similarity) -> Column:
    """Whether a page is the company's: its ticker, a name token of four letters or a similar title; NULL if it could not be read."""
    low = F.lower(text)
    told = F.coalesce(F.contains(low, F.lower(ticker)) & (ticker != ""), F.lit(False))
    named = F.coalesce(F.exists(tokens, lambda t: (F.length(t) >= 4) & (t != F.lower(F.coalesce(ticker, F.lit("")))) & F.contains(low, t)), F.lit(False))
    return F.when(F.coalesce(status < 400, F.lit(False)) & text.isNotNull(), told | named | F.coalesce(title_similarity >= 60, F.lit(False)))
