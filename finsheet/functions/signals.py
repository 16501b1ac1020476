"""What a link's wording says for and against a report: plain words with weights, matched on a text of words.

A text is read in lower case with everything but letters, digits and signs outside ASCII turned into single blanks, so that
``half-year``, ``half_year`` and ``half year`` are one wording. A word of a table is found wherever it stands; one that ends and
begins with a blank is found only as a whole word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings of a report, with their weights.
FOR = (
    (40, ("consolidated financial statement",)),
    (35, ("audited",)),
    (38, ("annual financial report", "annual financial statement")),
    (32, ("financial statement",)),
    (30, (" afs ", " fs ", "financial stmt", "financialstmt")),
    (30, ("annual report", "annualreport", " ar 20")),
    (35, ("form 10k", "form 10 k", "form 20f", "form 20 f", "form 40f", "form 40 f")),
    (25, (" 10k ", " 10 k ", " 20f ", " 20 f ", " 40f ", " 40 f ")),
    (12, ("annual information form", " aif ")),
    (22, ("integrated report", "group report")),
    (32, ("年度報告", "年度报告", "年報", "年报")),
    (34, ("綜合財務報表", "合併財務報表", "财务报表", "財務報表", "財務報告", "财务报告")),
)
#: Wordings of other papers, with their weights.
AGAINST = (
    (45, ("interim", "half year", "halfyear", " quarter", "6 months", " q1 ", " q2 ", " q3 ", " q4 ", "triwulan", "kuartal")),
    (25, (" mda ", " md a ", "management discussion")),
    (40, ("tender", "offer to purchase", "prospectus", "supplement")),
    (45, ("esg", "sustainab", " csr ", "climate", "carbon", "diversity", "impact report")),
    (30, ("proxy", "circular", " agm ", "notice of meeting", "information statement", "voting")),
    (35, ("present", "slides", "transcript", "webcast", "factsheet", "fact sheet", "infographic", "fireside")),
    (22, ("summary", "highlights", "press release", "news release", " pr ", "media", "alert")),
    (12, ("governance", "remuneration report", "compensation discussion")),
    (45, ("disclosure return", "monthly return", "equity issuer", "movement in", "movements in", "next day", "poll result", "notifiable", "connected transaction", "notice of", "nomination")),
    (45, ("中期報告", "中期报告", "中期業績", "中期业绩", "季度報告", "季度报告", "半年報", "半年报", "季報", "季报", "季度")),
    (25, ("公告", "通函", "簡報", "简报", "演示", "業績發布", "业绩发布")),
    (40, ("可持續", "可持续", "永續", "永续")),
)
#: What an address of a document holds, as it is printed.
DOCUMENTS = (".pdf", "download", "/doc", "ecms-files")


def as_words(text: Column) -> Column:
    """Lower case, one blank before, between and after words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")), F.lit(" "))


def any_of(words: Column, table: tuple[str, ...]) -> Column:
    return reduce(lambda held, w: held | F.contains(words, F.lit(w)), table, F.lit(False))


def weight_of(words: Column, table: tuple) -> Column:
    """Sum of the weights whose wordings occur."""
    return reduce(lambda total, row: total + F.when(any_of(words, row[1]), row[0]).otherwise(0), table, F.lit(0))


def year_of(words: Column) -> Column:
    """The latest year named: four digits of 1900 to 2099 that stand alone or next to letters, or two to four after ``fy``."""
    numbers = F.transform(F.filter(F.split(F.regexp_replace(words, "[^0-9]+", " "), " "), lambda n: F.length(n) == 4), lambda n: n.cast("int"))
    plain = F.filter(numbers, lambda y: y.between(1900, 2099))
    fiscal = F.transform(F.filter(F.slice(F.split(words, "fy"), 2, 1000), lambda rest: rest.rlike("^ ?[0-9]{2}")), lambda rest: F.regexp_extract(rest, "^ ?([0-9]{2,4})", 1).cast("int"))
    return F.array_max(F.concat(plain, F.transform(fiscal, lambda y: F.when(y < 100, 2000 + y).otherwise(y))))


def names_a_report_of_a_year(words: Column) -> Column:
    """``report 2025`` or ``FY2025 report``: a year beside the word."""
    beside = F.slice(F.split(words, " report "), 1, 1000)
    after = F.exists(F.slice(beside, 2, 1000), lambda rest: rest.rlike("^(fy)?20[0-9]{2}"))
    before = F.exists(F.slice(beside, 1, F.size(beside) - 1), lambda start: start.rlike("(fy)?20[0-9]{2}$"))
    return after | before


def names_a_quarter(words: Column) -> Column:
    """A word such as 3q26, q3fy26 or fy26q3."""
    return F.exists(F.split(words, " "), lambda w: w.rlike("^[1-4]q[0-9]{2}") | w.rlike("^q[1-4](fy|[0-9]{2})") | w.rlike("^fy[0-9]{2,4}q[1-4]"))
