"""Text functions over columns: folding, names, identifiers, links, candidate-page tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
#: Legal endings of company names, longest first.
LEGAL = ("incorporated", "corporation", "company", "limited", "holdings", "group", "corp", "gmbh", "plc", "inc", "ltd", "llc", "spa", "ag", "sa", "nv", "se", "co", "as", "ab", "oyj")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x) -> Column:
    """Lower case without accents, ligatures, typographic quotes or hard spaces."""
    s = F.translate(_c(x), _ACCENTED, _PLAIN)
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("’", "'"), (" ", " ")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.lower(s)


def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"\s+", " "))


def key_of_name(x) -> Column:
    """Name as a key: lower case, ampersand spelled out, punctuation and double blanks gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9 ]", " "), r" +", " "))


def strip_legal(x) -> Column:
    """A name without one trailing legal ending."""
    return F.trim(F.regexp_replace(_c(x), r"(?i)[ ,]+(" + "|".join(LEGAL) + r")\.?$", ""))


def name_tokens(x, shortest: int = 3, stop: Iterable[str] = LEGAL) -> Column:
    words = F.split(key_of_name(x), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(*stop)))


def tokens_match(a: Column, b: Column) -> Column:
    """Whether one token set contains the other; empty sets match nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def local_name(x) -> Column:
    return F.element_at(F.split(_c(x), ":"), -1)


def member_label(x) -> Column:
    """``ns:SomeCustomPlanMember`` to ``Some Custom Plan``."""
    return F.trim(F.regexp_replace(F.regexp_replace(local_name(x), "Member$", ""), "(?<=[a-z0-9])(?=[A-Z])", " "))


def html_text(x) -> Column:
    """Markup to text: rows end lines, cells end with `` | ``, other tags are blanks, basic entities decoded."""
    s = F.regexp_replace(_c(x), "(?i)</tr>", "\n")
    s = F.regexp_replace(s, "(?i)</t[dh]>", " | ")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, "[ \t]+", " "))


def host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z]+://([^/:?#]+)", 1))


def registrable(url, second_level: tuple[str, ...] = ("co", "com", "org", "net", "gov", "ac")) -> Column:
    """The last two labels of a host, or three under a second-level suffix such as ``co.uk``."""
    parts = F.split(host(url), r"\.")
    deep = (F.size(parts) >= 3) & F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).isin(*second_level) & (F.length(F.element_at(parts, -1)) == 2)
    take = F.when(deep, 3).otherwise(F.least(F.lit(2), F.size(parts)))
    return F.array_join(F.slice(parts, -take, take), ".")


def cache_key(*parts) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[_c(p) for p in parts]), 256), 1, 32)


def is_isin(x) -> Column:
    return _c(x).rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")


def is_lei(x) -> Column:
    return _c(x).rlike("^[A-Z0-9]{18}[0-9]{2}$")


def digits(x) -> Column:
    return F.regexp_replace(_c(x), "[^0-9]", "")


def padded(x, width: int) -> Column:
    return F.when(F.length(digits(x)) > 0, F.lpad(digits(x), width, "0"))


def safe_file_name(x, longest: int = 40) -> Column:
    return F.substring(F.regexp_replace(_c(x), "[^A-Za-z0-9._-]+", "_"), 1, longest)


def digit_density(x) -> Column:
    return F.length(digits(x)) / F.nullif(F.length(_c(x)), F.lit(0))


def head_and_tail(x, dense: float = 0.10, long: int = 3500, short: int = 2500, tail: int = 1500) -> Column:
    """The start and the end of a long text; number-heavy pages keep a longer start."""
    head = F.when(digit_density(x) > dense, long).otherwise(short)
    return F.when(F.length(_c(x)) <= head + tail, _c(x)).otherwise(F.concat(F.substring(_c(x), F.lit(1), head), F.lit("\n[...]\n"), F.right(_c(x), F.lit(tail))))


def verdict(x) -> Column:
    """(keep, confidence, reason) of a page classifier's answer; anything unclear keeps the page with low confidence."""
    s = _c(x)
    decision = F.upper(F.regexp_extract(s, r"(?i)DECISION:\s*(KEEP|SKIP)", 1))
    confidence = F.upper(F.regexp_extract(s, r"(?i)CONFIDENCE:\s*(HIGH|MEDIUM|LOW)", 1))
    reason = F.substring(F.trim(F.regexp_replace(F.regexp_extract(s, r"(?is)REASON:\s*(.*)", 1), r"\s+", " ")), 1, 200)
    return F.struct((decision != "SKIP").alias("keep"), F.when(confidence == "", "LOW").otherwise(confidence).alias("confidence"), reason.alias("reason"))
