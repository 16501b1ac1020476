"""Pairing extracted labels with the rows of a page's text again, by a cursor that only moves forward.

A parse may shift a table's values against its labels; the page's text has each label before its own numbers. Labels and rows are
compared as words: runs of anything but letters and digits are one blank, so punctuation between the words of a label does not
matter. The walk is one fold over a document's labels, no Python and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsheet.functions.coerce import once, text_number

#: Least and share of matched rows that must contradict their values before any is replaced, and what rounding may hide.
LEAST, SHARE, ROUNDING = 5, 0.15, 0.6
NUMBER = r"(\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?)"
_OTHER = r"[^\p{L}\p{N}]+"


def as_words(text: Column) -> Column:
    """Lower case, one blank around words and between them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), _OTHER, " ")), F.lit(" "))


def _numbers(line: Column, words: Column) -> Column:
    """Numbers between a label's first occurrence on a line and the next letter."""
    label = F.array_join(F.split(F.trim(words), " "), r"[^\p{L}\p{N}]+")
    rest = F.call_function("regexp_extract", F.lower(line), F.concat(F.lit(r"(?:^|[^\p{L}\p{N}])"), label, F.lit(r"(?![\p{L}\p{N}])([^\p{L}]*)")), F.lit(1))
    return F.filter(F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(1)), text_number), lambda n: n.isNotNull())


def pair(labels: DataFrame, lines: DataFrame, by: str, shortest: int = 4) -> DataFrame:
    """(by, pos, label, line_no, numbers): each label's row and the numbers printed there; NULL where no row is left that holds it.

    ``labels`` has (by, pos, label), ``lines`` (by, line_no, text); a group is one document's statement. Labels of fewer than
    ``shortest`` letters and digits match nothing.
    """
    a = labels.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("__labels"))
    b = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("__lines"))
    both = a.join(b, by, "left").withColumn("__lines", F.coalesce("__lines", F.array().cast(b.schema["__lines"].dataType)))
    both = once(both, __labels=F.transform("__labels", lambda x: F.struct(x["pos"].alias("pos"), x["label"].alias("label"), as_words(x["label"]).alias("words"))), __rows=F.transform("__lines", lambda x: as_words(x["text"])))
    n = F.size("__rows")

    def step(state: Column, x: Column) -> Column:
        here = state["cursor"]
        left = F.slice("__rows", here + 1, F.greatest(n - here, F.lit(0)))
        wanted = F.length(x["words"]) - 2 >= shortest
        hit = F.when(wanted, F.array_position(F.transform(left, lambda row: F.contains(row, x["words"])), True).cast("int"))
        at = F.when(hit > 0, here + hit)
        return F.struct(F.coalesce(at, here).alias("cursor"), F.concat(state["found"], F.array(at)).alias("found"))

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("found"))
    walked = once(both, __found=F.aggregate("__labels", start, step)["found"])
    each = walked.select(by, "__lines", F.explode(F.arrays_zip(F.col("__labels").alias("l"), F.col("__found").alias("at"))).alias("p")).select(by, F.get("__lines", F.col("p.at") - 1).alias("line"), "p.l.pos", "p.l.label", "p.l.words")
    return each.select(by, "pos", "label", F.col("line.line_no").alias("line_no"), F.when(F.col("line").isNotNull(), _numbers(F.col("line.text"), F.col("words"))).alias("numbers"))


def repaired(items: DataFrame, paired: DataFrame, by: str, value: str, oldest_first: Column | None = None) -> DataFrame:
    """``items`` (by, pos, label, value) with values that contradict their rows replaced by the row's latest number.

    A value that is among its row's numbers is confirmed. Nothing is replaced unless LEAST rows and SHARE of the matched ones
    are contradicted, so a single oddity stays for the tally to flag. Adds ``replaced``.
    """
    rows = items.join(paired.select(by, "pos", "numbers"), [by, "pos"], "left")
    matched = F.coalesce(F.size("numbers"), F.lit(0)) > 0
    confirmed = F.exists("numbers", lambda n: F.abs(n - F.coalesce(F.col(value), F.lit(0.0))) <= ROUNDING)
    rows = rows.withColumn("__wrong", matched & ~F.coalesce(confirmed, F.lit(False))).withColumn("__matched", matched)
    group = Window.partitionBy(by)
    wrong, seen = F.count_if("__wrong").over(group), F.count_if("__matched").over(group)
    latest = F.get("numbers", F.lit(0)) if oldest_first is None else F.when(oldest_first, F.try_element_at("numbers", F.lit(-1))).otherwise(F.get("numbers", F.lit(0)))
    rows = rows.withColumn("replaced", F.col("__wrong") & (wrong >= LEAST) & (wrong >= SHARE * seen))
    return rows.withColumn(value, F.when(F.col("replaced"), latest).otherwise(F.col(value))).drop("numbers", "__wrong", "__matched")
