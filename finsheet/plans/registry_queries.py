"""Entity-resolution and reference-table queries over the driver tables: customers, suppliers and parts are registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.functions import maps, text
from finsheet.operators import approx, resolve, similarity
from finsheet.plans.tables import table

_TOKENS = [s for s, _ in maps.LADDER] + [m for _, m in maps.LADDER] + ["XX"]


def rating_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (F.col("c_custkey") % len(_TOKENS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", token.alias("token"))
    return rows.select("c_custkey", "token", maps.snap_rating(F.col("token")).alias("rung"), maps.agency_of_rating(F.col("token")).alias("agency"))


def _rating_sql() -> str:
    ladder = ", ".join(f"({i}, '{s}', '{m}', rtrim('{s}', '+-'))" for i, (s, m) in enumerate(maps.LADDER, 1))
    rungs = ", ".join(f"('{label}', '{s}')" for label, s in maps.RUNGS)
    tokens = ", ".join(f"'{t}'" for t in _TOKENS)
    return f"""
WITH l(r, sp, m, fam) AS (VALUES {ladder}), g AS (SELECT label, l.r, l.fam FROM (VALUES {rungs}) AS v(label, sp) JOIN l USING (sp)),
t AS (SELECT token, min(r) AS r, min(fam) AS fam FROM (SELECT unnest([{tokens}]) AS token) LEFT JOIN l ON upper(token) IN (upper(sp), upper(m)) GROUP BY token),
b AS (SELECT token, arg_min(g.label, (abs(g.r - t.r), CASE WHEN g.fam = t.fam THEN 0 ELSE 1 END, g.r)) AS rung FROM t CROSS JOIN g WHERE t.r IS NOT NULL GROUP BY token),
c AS (SELECT c_custkey, [{tokens}][c_custkey % {len(_TOKENS)} + 1] AS token FROM customer)
SELECT c_custkey, token, rung, CASE WHEN token IN (SELECT sp FROM l) AND token IN (SELECT m FROM l) THEN 'S&P/Moody''s' WHEN token IN (SELECT sp FROM l) THEN 'S&P' WHEN token IN (SELECT m FROM l) THEN 'Moody''s' END AS agency FROM c LEFT JOIN b USING (token)"""


RATING_SNAP = _rating_sql()


_PREFIXES = [*(x + ":" for x in maps.EXCHANGES), "nasdaq:", "TSE:", "ZZZ:", ""]


def exchange_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' tickers with every prefix in turn; one that is unknown or that two countries use leaves the given country."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in _PREFIXES]), (F.col("s_suppkey") % len(_PREFIXES) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(prefix, F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit("Iceland").alias("given"))
    return resolve.with_country(rows, "ticker", "given").select("s_suppkey", "bare_ticker", "country")


_LISTED = ", ".join(f"('{c}', [{', '.join(repr(x) for x in p)}])" for c, p in maps.PREFIXES.items())
EXCHANGE_PREFIX = f"""
WITH c AS (SELECT country, unnest(prefixes) AS prefix FROM (VALUES {_LISTED}) AS v(country, prefixes)),
s AS (SELECT s_suppkey, [{", ".join(repr(x) for x in _PREFIXES)}][s_suppkey % {len(_PREFIXES)} + 1] AS p FROM supplier)
SELECT s_suppkey, 'T' || s_suppkey AS bare_ticker, coalesce(country, 'Iceland') AS country FROM s LEFT JOIN c ON prefix = upper(rtrim(p, ':'))"""


def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys as queries against customers: by code, else by ticker, else by name."""
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code"), F.upper(F.substring("c_name", 10, 9)).alias("symbol"), F.upper("c_name").alias("name"), "c_mktsegment")
    k = F.col("s_suppkey")
    queries = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, k.cast("string")).alias("q_code"), F.when(k % 3 <= 1, F.lpad((k * 2).cast("string"), 9, "0")).alias("q_symbol"), F.concat(F.lit("CUSTOMER#"), F.lpad((k * 3).cast("string"), 9, "0")).alias("q_name"))
    rules = [("code", "q_code", "code"), ("ticker", "q_symbol", "symbol"), ("name", "q_name", "name")]
    return resolve.cascade(queries, registry, rules, "s_suppkey", ["code"]).select("s_suppkey", "matched_via", "code", "c_mktsegment")


RESOLVE_CASCADE = """
WITH r AS (SELECT c_custkey, c_mktsegment FROM customer),
q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey * 2 ELSE s_suppkey * 3 END AS k, CASE s_suppkey % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'ticker' ELSE 'name' END AS matched_via FROM supplier)
SELECT s_suppkey, matched_via, CAST(k AS VARCHAR) AS code, c_mktsegment FROM q JOIN r ON r.c_custkey = k"""


def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and colours as name fragments: the best part whose name contains each (small parts first, then the shortest name)."""
    queries = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("query")).distinct()
    pairs = resolve.contains_join(queries, table(spark, sf_dir, "part"), "query", "p_name")
    return resolve.best_by_name(pairs, "query", "p_name", F.col("p_size") < 10, ["p_name", "p_partkey"]).select("query", "p_partkey", "p_name")


NAME_CONTAINS = """
WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part),
r AS (SELECT query, p_partkey, p_name, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN p_size < 10 THEN 0 ELSE 1 END, length(p_name), p_name, p_partkey) AS k FROM q JOIN part ON contains(upper(p_name), upper(query)))
SELECT query, p_partkey, p_name FROM r WHERE k = 1"""


def exact_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "part").select(F.split("p_name", " ")[1].alias("query")).distinct()
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    ranked = resolve.exact_then_shortest(resolve.contains_join(queries, names, "query", "p_name"), "query", "query", "p_name", ["p_name"])
    return ranked.where("position <= 3").select("query", "p_name", F.col("position").cast("long").alias("position"))


EXACT_SHORTEST = """
WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS query FROM part), n AS (SELECT DISTINCT p_name FROM part),
r AS (SELECT query, p_name, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN lower(query) = lower(p_name) THEN 0 ELSE 1 END, length(p_name), p_name) AS position FROM q JOIN n ON contains(lower(p_name), lower(query)))
SELECT * FROM r WHERE position <= 3"""


def prefix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("query")).distinct()
    registry = table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_retailprice").alias("filed"))
    return resolve.prefix_family(queries, registry, "query", "p_name", "filed", "query").select("query", "p_name", "filed")


PREFIX_FAMILY = """
WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part), n AS (SELECT p_name, max(p_retailprice) AS filed FROM part GROUP BY p_name),
r AS (SELECT query, p_name, filed, row_number() OVER (PARTITION BY query ORDER BY length(p_name), p_name, filed DESC) AS k FROM q JOIN n ON starts_with(upper(p_name), upper(query)))
SELECT query, p_name, filed FROM r WHERE k = 1"""


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names with accents, other punctuation or a legal ending still find their row by the first spelling that does."""
    registry = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey") % 5
    typed = F.when(k == 0, F.replace("s_name", F.lit("Supplier"), F.lit("Suppliér"))).when(k == 1, F.concat("s_name", F.lit(" SpA"))).when(k == 2, F.replace("s_name", F.lit("#"), F.lit("'"))).when(k == 3, F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(" PLC"))).otherwise(F.col("s_name"))
    queries = registry.select(F.col("s_suppkey").alias("q"), typed.alias("typed"))
    return resolve.first_variant(queries, registry, "typed", "s_name", "q", ["s_suppkey"]).select("q", F.col("tried"), "spelling", "s_suppkey")


NAME_VARIANTS = """
WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN replace(s_name, 'Supplier', 'Suppliér') WHEN 1 THEN s_name || ' SpA' WHEN 2 THEN replace(s_name, '#', chr(39)) WHEN 3 THEN replace(s_name, '#', '-') || ' PLC' ELSE s_name END AS q FROM supplier),
f AS (SELECT *, lower(replace(q, 'é', 'e')) AS p FROM s),
g AS (SELECT *, CASE WHEN regexp_matches(p, ' (spa|plc)$') THEN regexp_replace(p, ' (spa|plc)$', '') END AS b FROM f),
v AS (SELECT k, unnest([q, p, regexp_replace(p, '[^0-9a-z ]', '_', 'g'), b, regexp_replace(b, '[^0-9a-z ]', '_', 'g')]) AS spelling, unnest([0, 1, 2, 3, 4]) AS i FROM g),
d AS (SELECT k, spelling, min(i) AS i FROM v WHERE spelling IS NOT NULL GROUP BY ALL),
e AS (SELECT k, spelling, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS tried FROM d),
r AS (SELECT e.k, tried, spelling, s_suppkey FROM e JOIN supplier ON lower(replace(spelling, 'é', 'e')) IN (lower(s_name), regexp_replace(lower(s_name), '[^0-9a-z ]', '_', 'g')))
SELECT k AS q, CAST(min(tried) AS INTEGER) AS tried, arg_min(spelling, (tried, s_suppkey)) AS spelling, arg_min(s_suppkey, (tried, s_suppkey)) AS s_suppkey FROM r GROUP BY k"""


def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of three words out of the benchmark, some glued or with a stop word, found in documents."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    three = F.slice("w", 2, 3)
    name = F.when(F.col("item_id") % 3 == 0, F.array_join(three, "")).when(F.col("item_id") % 3 == 1, F.concat(F.array_join(three, " "), F.lit(" Limited"))).otherwise(F.array_join(three, "-"))
    names = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).select(name.alias("name"))
    return resolve.names_in_texts(table(spark, sf_dir, "documents"), names, "doc_id", "text", "name", stop=("limited",))


NAMES_IN_TEXTS = """
WITH b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')[2:4] AS w FROM benchmark),
n AS (SELECT DISTINCT CASE item_id % 3 WHEN 0 THEN array_to_string(w, '') WHEN 1 THEN array_to_string(w, ' ') || ' Limited' ELSE array_to_string(w, '-') END AS name FROM b),
t AS (SELECT name, list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4 AND x <> 'limited') AS w FROM n),
u AS (SELECT name, array_to_string(w, '') AS slug, CASE WHEN len(list_filter(w, lambda x: length(x) >= 5)) > 0 THEN list_filter(w, lambda x: length(x) >= 5) ELSE w END AS need FROM t WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, list_distinct(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, name, CASE WHEN max(CASE WHEN list_contains(w, slug) THEN 1 ELSE 0 END) = 1 THEN 'slug' ELSE 'words' END AS via FROM d JOIN u ON list_contains(w, slug) OR list_has_all(w, need) GROUP BY doc_id, name"""


def token_subset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    short = names.select(F.split("p_name", " ")[0].alias("short")).distinct()
    return resolve.token_subset_pairs(short, names, "short", "p_name").select("short", "p_name")


TOKEN_SUBSET_MATCH = """
WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS short FROM part),
t AS (SELECT p_name, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 3)) AS t FROM n)
SELECT short, p_name FROM s JOIN t ON length(short) >= 3 AND len(t) > 0 AND (list_contains(t, short) OR t = [short])"""


def crosslisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' codes as foreign lines of US-listed customers."""
    registry = table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("us_ticker"), F.concat(F.lit("Issuer "), F.chr(F.col("c_custkey") % 26 + 65), F.lit("corp Inc")).alias("us_name"))
    k = F.col("s_suppkey")
    requests = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(k % 2 == 0, "1").otherwise(""), F.lit("T"), k.cast("string")).alias("ticker"), F.when(k % 3 == 0, F.concat(F.lit("issuer "), F.chr(k % 26 + 65), F.lit("corp"))).alias("name"), F.when(k % 5 == 0, "United States").otherwise("Italy").alias("country"))
    return resolve.crosslisted(requests, registry, "ticker", "name", "country", "us_ticker", "us_name").select("s_suppkey", "us_match")


CROSSLISTED = """
SELECT s_suppkey, CASE WHEN c_custkey IS NOT NULL AND s_suppkey % 5 <> 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) THEN 'T' || s_suppkey END AS us_match FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey"""


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier tests, padding, cache keys and file names made of supplier keys."""
    k = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("US"), k, F.when(F.col("s_suppkey") % 2 == 0, "5").otherwise("X")).alias("isin"), "s_name")
    return rows.select("s_suppkey", text.is_isin("isin").alias("is_isin"), text.padded("s_name", 6).alias("padded"), text.cache_key(F.lit("bs"), "s_name").alias("key"), text.safe_file_name("s_name").alias("file"))


IDENTIFIERS = """
SELECT s_suppkey, s_suppkey % 2 = 0 AS is_isin, left(lpad(regexp_replace(s_name, '[^0-9]', '', 'g'), 6, '0'), 6) AS padded, substr(sha256('bs' || chr(0) || s_name), 1, 32) AS key, replace(s_name, '#', '_') AS file FROM supplier"""


def industry_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as industries: the dictionary, the REIT prefix, then the fuzzy layer."""
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Banks-Regional", "REIT - Offices", "thermal  coal", "Steel", "??", "", "Semiconductors", "Homebuildings", "Green Renewable Energy")]), (F.col("p_size") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    name, method = approx.industry(F.col("raw"))
    return rows.select("p_partkey", "raw", name.alias("industry"), method.alias("method"))


INDUSTRY_MAP = """
WITH w AS (SELECT unnest(range(0, 9)) AS k, unnest(['Banks-Regional', 'REIT - Offices', 'thermal  coal', 'Steel', '??', '', 'Semiconductors', 'Homebuildings', 'Green Renewable Energy']) AS raw,
    unnest(['Banks (Regional)', 'R.E.I.T.', 'Coal & Related Energy', 'Steel', NULL, NULL, 'Semiconductor', 'Homebuilding', 'Green & Renewable Energy']) AS industry, unnest(['dict', 'dict', 'dict', 'dict', 'none', 'none', 'fuzzy', 'fuzzy', 'fuzzy']) AS method)
SELECT p_partkey, raw, industry, method FROM part JOIN w ON p_size % 9 = k"""


def fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with letters dropped, matched to the registry of distinct names by similarity (at least 0.8)."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    queries = names.select(F.regexp_replace("p_name", "[aeo]$|[aeo](?= )", "").alias("typed")).distinct()
    return approx.similar_names(queries, names, "typed", "p_name", 0.8)


def token_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask for the part of their number by a misspelt name with its words turned round; all part names that are alike as sets of words (80 and more)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    asked = F.concat_ws(" ", F.element_at(F.split("name", " "), 3), F.regexp_replace(F.element_at(F.split("name", " "), 1), "[aeiou]$|l$", ""), F.element_at(F.split("name", " "), 2))
    queries = table(spark, sf_dir, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(asked.alias("asked"))
    return similarity.alike_as_sets(queries, part, "asked", "name", 80).select("query", "name", F.bround("ratio", 4).alias("ratio"))


TOKEN_SET_MATCH = r"""
WITH p AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part),
q AS (SELECT DISTINCT string_split(name, ' ')[3] || ' ' || regexp_replace(string_split(name, ' ')[1], '[aeiou]$|l$', '') || ' ' || string_split(name, ' ')[2] AS query FROM supplier JOIN p ON s_suppkey = p_partkey),
n AS (SELECT DISTINCT name FROM p),
f AS (SELECT s, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(s), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> ''))) AS w FROM (SELECT query AS s FROM q UNION SELECT name FROM n)),
m AS (SELECT query, name, a.w AS x, b.w AS y FROM q JOIN f a ON a.s = query CROSS JOIN n JOIN f b ON b.s = name),
d AS (SELECT query, name, len(list_filter(x, lambda w: list_contains(y, w))) AS shared, len(x) AS nx, len(y) AS ny, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS s,
    array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS l, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS r FROM m),
e AS (SELECT DISTINCT l, r FROM d WHERE l <> '' AND r <> ''),
k AS (SELECT l, r, list_reduce(list_prepend((1::BIGINT << length(l)) - 1, list_transform(string_split(r, ''), lambda c: -1 - list_sum(list_transform(range(0, length(l)), lambda i: CASE WHEN l[i + 1] = c THEN 1::BIGINT << i ELSE 0 END)))),
    lambda v, t: ((v + (v & (-1 - t))) | (v - (v & (-1 - t)))) & ((1::BIGINT << length(l)) - 1)) AS v FROM e),
c AS (SELECT l, r, length(l) - bit_count(v) AS common FROM k),
g AS (SELECT query, name, shared, nx, ny, length(s) AS s, length(s) + CASE WHEN shared > 0 THEN 1 ELSE 0 END + length(d.l) AS one, length(s) + CASE WHEN shared > 0 THEN 1 ELSE 0 END + length(d.r) AS two, coalesce(common, 0) AS common FROM d LEFT JOIN c ON c.l = d.l AND c.r = d.r),
z AS (SELECT query, name, CASE WHEN nx = 0 OR ny = 0 THEN 0 WHEN shared > 0 AND (shared = nx OR shared = ny) THEN 100.0 ELSE greatest(200.0 * (s + CASE WHEN shared > 0 THEN 1 ELSE 0 END + common) / (one + two), CASE WHEN shared > 0 THEN 200.0 * s / (s + least(one, two)) ELSE 0 END) END AS ratio FROM g)
SELECT query, name, round_even(CAST(ratio AS DOUBLE), 4) AS ratio FROM z WHERE ratio >= 80 - 1e-9"""


def rating_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings said in texts: documents with a sentence about one put in front."""
    k = F.col("doc_id")
    token = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (k % len(_TOKENS) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Credit rating: "), token, F.when(k % 2 == 0, " with stable outlook. ").otherwise(". "), F.coalesce("text", F.lit(""))).alias("text"))
    return approx.ratings(docs, "doc_id", "text")
