"""URL filters: rules of a host and a path, found by hash prefixes of the expressions that each URL expands to.

A rule fits its host and all subdomains, where the URL's path starts with the rule's. Its key is its host and its path up to
the last ``/``. A URL has an expression for each of its host's suffixes (whole labels) and each of its path's prefixes (that
end in ``/``, and the empty one), but none with more labels or more ``/`` than the longest rule has, so a URL of any length
gives a bounded number of them. URL and rules meet where the first BITS bits of their keys' SHA-256 are equal; whoever meets
is confirmed by the whole digest, and by the rest of the rule's path. Of the rules that fit, the longest wins: by length of
host and path together, then of the host; of equal rules that say both, block. A URL without a rule is allowed, as with any
list of what to block.

URLs are judged once for each distinct pair of host and path and the verdicts joined back, so copies of a page or a host
that holds a third of all pages cost one row for each of their paths. A small table of rules is sent to the tasks by Spark's
own size check, a large one is joined by the hash prefix.

Defined cases: null URLs and those without ``://`` have an empty host and path, so that no rule fits; only A-Z is
lower-cased; a port or user name is part of the host; repeated rows are judged each; rules are lower-cased in the same way and
those with a null host, path or verdict dropped; repeated rules count once; an empty table gives no rows, no rules allow all;
extra columns, whatever their names, are ignored by ``judged`` and kept by ``allowed_only``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digest that URL and rule meet by.
BITS = 32
RULE = "host string, path string, verdict string"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, BITS // 4)


def _folder(path: Column) -> Column:
    """A path up to its last ``/``."""
    return F.regexp_extract(path, "^(?s).*/", 0)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their key's digest; of rules of one host and path, block wins."""
    own = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    return own.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", _digest(F.col("host"), _folder(F.col("path"))).alias("rule_digest"))


def expressions(urls: DataFrame, labels: int, folders: int) -> DataFrame:
    """(host, path, host_suffix, folder) of distinct URLs: suffixes of up to ``labels`` labels, prefixes of up to ``folders`` ``/``."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    slashes = F.length("path") - F.length(F.translate("path", "/", ""))
    # substring_index takes no column as its count, so prefixes are built from the pieces between the slashes.
    pieces = F.slice(F.split("path", "/"), 1, folders)
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(folders))), lambda k: F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/"))))
    prefixes = F.when(slashes > 0, prefixes).otherwise(F.array(F.lit("")))
    return urls.select("host", "path", F.explode(suffixes).alias("host_suffix"), prefixes.alias("prefixes")).select("host", "path", "host_suffix", F.explode("prefixes").alias("folder"))


def judged(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the rule that won, else null), verdict (allow or block)."""
    url = F.col(f"`{url_column}`")
    own = pages.select(F.col(f"`{id_column}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rules = prepared(rules)
    n = lambda c, sign: F.length(c) - F.length(F.translate(c, sign, ""))
    longest = rules.agg(F.max(n("rule_host", ".") + 1).alias("labels"), F.max(n("rule_path", "/")).alias("folders")).first()  # one row
    met = expressions(own.select("host", "path").distinct(), max(1, longest.labels or 1), max(1, longest.folders or 1))
    met = met.withColumn("digest", _digest(F.col("host_suffix"), F.col("folder")))
    met = met.join(rules, _short(met["digest"]) == _short(rules["rule_digest"]))
    met = met.where((F.col("digest") == F.col("rule_digest")) & (F.col("host_suffix") == F.col("rule_host")) & F.startswith("path", F.col("rule_path")))
    weight = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), weight).alias("best"))
    out = own.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def allowed_only(pages: DataFrame, rules: DataFrame, url_column: str = "url") -> DataFrame:
    """``pages`` without the rows whose URL is blocked; every column is kept."""
    url = F.col(f"`{url_column}`")
    blocked = judged(pages.select(F.lit(0).alias("page_id"), url.alias("url")), rules).where("verdict = 'block'").select(F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
    return pages.join(blocked, (host_of(url) == F.col("__host")) & (path_of(url) == F.col("__path")), "left_anti")
