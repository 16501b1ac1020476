"""Page, link and text queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsheet.functions import coerce, dates, signals, text
from finsheet.operators import filings, patterns, realign
from finsheet.plans.tables import table

_TIERS = ("title", "code", "valuation", "rollforward", "generic", "header", "foreign")


def _benchmark_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tier, pos, pattern): every third pair of neighbouring words of the benchmark, dealt to the tiers in turn."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: i % 3 == 1), lambda i: F.struct(i.alias("i"), F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))
    each = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where("size(w) > 1").select("item_id", F.explode(pairs).alias("p"))
    kept = each.where("length(p.a) >= 3 and length(p.b) >= 3").groupBy("p.a", "p.b").agg(F.min(F.struct("item_id", "p.i")).alias("at"))
    tier = F.element_at(F.array(*[F.lit(t) for t in _TIERS]), ((F.col("at.item_id") + F.col("at.i")) % len(_TIERS) + 1).cast("int"))
    return kept.select(tier.alias("tier"), (F.col("at.item_id") * 100_000 + F.col("at.i")).alias("pos"), F.concat("a", F.lit(r"[ \n]+"), "b").alias("pattern"))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, some hundred patterns of the benchmark as the landed table: which may hold the note, and why. A null text is an empty page."""
    found = patterns.matcher(_benchmark_patterns(spark, sf_dir))
    pages = coerce.once(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), hits=patterns.pattern_hits(F.col("text"), found))
    ok, reason = filings.candidate_page(patterns.tiers_of(F.col("hits"), _TIERS), F.col("text"), F.col("text").rlike(r"\d[\d,.]+"))
    return coerce.once(pages, verdict=F.struct(ok.alias("candidate"), reason.alias("reason"))).select("doc_id", "verdict.*")


PAGE_CANDIDATES = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
e AS (SELECT item_id, unnest(range(1, len(w), 3)) AS i, w FROM b),
k AS (SELECT w[i] AS a, w[i + 1] AS b, min((item_id, i)) AS m FROM e WHERE length(w[i]) >= 3 AND length(w[i + 1]) >= 3 GROUP BY ALL),
p AS (SELECT ['title', 'code', 'valuation', 'rollforward', 'generic', 'header', 'foreign'][(m[1] + m[2]) % 7 + 1] AS tier, m[1] * 100000 + m[2] AS pos, a, b FROM k),
t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
f AS (SELECT doc_id, tier, pos, regexp_extract(low, a || '[ \n]+' || b) AS hit FROM t JOIN p ON contains(low, a) AND contains(low, b)),
h AS (SELECT doc_id, tier, list(hit ORDER BY pos) AS h FROM f WHERE hit <> '' GROUP BY ALL),
d AS (SELECT doc_id, text, regexp_matches(text, '\d[\d,.]+') AS tabled, {columns} FROM t),
n AS (SELECT *, coalesce(len(rollforward), 0) AS r, coalesce(len(generic), 0) + coalesce(len(header), 0) AS c FROM d),
r AS (SELECT doc_id, length(text) AS n, concat_ws('; ', 'note-title:' || title[1], 'plan-code:' || code[1], 'valuation:' || valuation[1],
    CASE WHEN r >= 3 THEN 'rollforward×' || r WHEN r > 0 AND c > 0 THEN 'rollforward×' || r || '+keyword' END,
    CASE WHEN tabled THEN 'generic+table:' || generic[1] END, CASE WHEN tabled THEN 'header+table:' || header[1] END, 'non-en:' || "foreign"[1]) AS reason FROM n)
SELECT doc_id, n >= 100 AND reason <> '' AS candidate, CASE WHEN reason = '' THEN '(no match)' ELSE reason END AS reason FROM r""".replace(
    "{columns}", ", ".join(f"(SELECT h FROM h WHERE h.doc_id = t.doc_id AND tier = '{x}') AS \"{x}\"" for x in _TIERS)
)


def digit_density_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = text.head_and_tail("text", dense=0.01, long=900, short=500, tail=300)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"), F.bround(text.digit_density("text"), 6).alias("density"))


DIGIT_DENSITY_TRUNC = """
WITH d AS (SELECT doc_id, text, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) END AS x FROM documents),
h AS (SELECT *, CASE WHEN x > 0.01 THEN 900 ELSE 500 END AS h FROM d),
c AS (SELECT doc_id, x, CASE WHEN length(text) <= h + 300 THEN text ELSE substr(text, 1, h) || chr(10) || '[...]' || chr(10) || right(text, 300) END AS t FROM h)
SELECT doc_id, length(t) AS n, md5(t) AS digest, round_even(x, 6) AS density FROM c"""


def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns next to a long one that are not long themselves."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.max("turn").over(Window.partitionBy("conv_id")).alias("last"))
    return filings.neighbours(rows, ["conv_id"], "turn", F.col("n") > 500, "last")


NEIGHBOUR_EXPAND = """
WITH c AS (SELECT conv_id, turn, length(text) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), k AS (SELECT * FROM c WHERE n > 500),
x AS (SELECT DISTINCT conv_id, unnest([turn - 1, turn + 1]) AS turn, last FROM k)
SELECT conv_id, turn FROM x WHERE turn BETWEEN 0 AND last AND NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = x.conv_id AND k.turn = x.turn)"""


def year_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    return filings.year_islands(years, ["o_custkey"], "year", 5)


YEAR_ISLANDS = """
WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), i AS (SELECT *, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS i FROM y)
SELECT o_custkey, min(y) AS first_year, max(y) AS last_year, count(*) AS n_years FROM i GROUP BY o_custkey, i HAVING count(*) >= 5"""


def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.links(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "url", F.col("pos").cast("long").alias("pos"))


LINK_HARVEST = """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS u FROM pages), x AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) - 1 AS pos FROM l)
SELECT page_id, url, min(pos) AS pos FROM x GROUP BY page_id, url"""


_ANCHORS = (
    "Annual report 2025", "2025年報", "Q3FY26 interim results", "Audited consolidated financial statements 2019", "ESG report 2024", "Slides", "2025財務年度中期報告", "form 10-k 2024 english",
    "FY2025 Report", "AFS 2023", "MD&A FY'24", "環境、社會及管治報告 2024", "pre_260512-1e", "3Q26 results", "Unaudited half_year summary", "", "Group report FY 19", "Notice of AGM 2025",
)


def link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses with report-like names, scored as of 2026; each once with its best score."""
    name = F.element_at(F.array(*[F.lit(x) for x in _ANCHORS]), (F.col("page_id") % len(_ANCHORS) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", name.alias("anchor"), F.concat("url", F.when(F.col("page_id") % 5 > 0, ".pdf").otherwise("")).alias("path"))
    best = filings.best_per_url(filings.document_scores(rows, "anchor", "path", 2026), [], "url", "score", ["page_id"])
    return best.select("url", "page_id", F.col("score").cast("long").alias("score"))


def _score_sql() -> str:
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    any_of = lambda words: "(" + " OR ".join(f"contains(w, {quoted(x)})" for x in words) + ")"
    total = lambda t: " + ".join(f"CASE WHEN {any_of(words)} THEN {weight} ELSE 0 END" for weight, words in t)
    return rf"""
WITH p AS (SELECT page_id, url, lower([{", ".join(quoted(x) for x in _ANCHORS)}][page_id % {len(_ANCHORS)} + 1] || ' ' || url || CASE WHEN page_id % 5 > 0 THEN '.pdf' ELSE '' END) AS b FROM pages),
t AS (SELECT page_id, url, b, ' ' || trim(regexp_replace(b, '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')) || ' ' AS w FROM p),
s AS (SELECT *, {total(signals.FOR)} + CASE WHEN regexp_matches(w, ' report (fy)?20\d\d') OR regexp_matches(w, '20\d\d report ') THEN 22 ELSE 0 END + CASE WHEN regexp_matches(w, ' fy20\d\d ') THEN 8 ELSE 0 END AS plus,
    {total(signals.AGAINST[1:-1])} + CASE WHEN {any_of(signals.AGAINST[0][1])} OR regexp_matches(w, ' ([1-4]q\d\d|q[1-4](fy|\d\d)|fy\d\d\d?\d?q[1-4])') THEN 45 ELSE 0 END
      + CASE WHEN {any_of(signals.AGAINST[-1][1])} OR regexp_matches(w, '[環环]境.{{0,4}}社[會会]') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(w, ' pre \d') THEN 35 ELSE 0 END AS minus,
    list_max(list_concat(list_filter(list_transform(list_filter(string_split(regexp_replace(w, '[^0-9]+', ' ', 'g'), ' '), lambda n: length(n) = 4), lambda n: CAST(n AS INTEGER)), lambda y: y BETWEEN 1900 AND 2099),
      list_transform(regexp_extract_all(w, 'fy ?(\d\d\d?\d?)', 1), lambda n: CASE WHEN length(n) = 2 THEN 2000 + CAST(n AS INTEGER) ELSE CAST(n AS INTEGER) END))) AS y FROM t),
a AS (SELECT *, plus - minus + CASE WHEN contains(w, ' en ') OR contains(w, 'english') THEN 8 ELSE 0 END + CASE WHEN y IS NULL THEN 0 ELSE greatest(-40, 25 - 7 * (2026 - y)) END AS s FROM s),
g AS (SELECT *, CASE WHEN plus = 0 THEN least(s, 5) ELSE s END AS s1 FROM a),
h AS (SELECT *, CASE WHEN NOT ({" OR ".join(f"contains(b, {quoted(x)})" for x in signals.DOCUMENTS)}) THEN -100 WHEN minus > plus AND plus < 20 THEN least(s1, 0) ELSE s1 END AS score FROM g)
SELECT url, arg_max(page_id, (score, page_id)) AS page_id, CAST(max(score) AS BIGINT) AS score FROM h GROUP BY url"""


LINK_SCORE = _score_sql()


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text.html_text("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).cast("long").alias("n"), F.md5(body).alias("digest"))


HTML_TO_TEXT = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)</tr>', chr(10), 'g'), '(?i)</t[dh]>', ' | ', 'g'), '<[^>]+>', ' ', 'g') AS s FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g')) AS t FROM a)
SELECT page_id, length(t) AS n, md5(t) AS digest FROM b"""


def host_registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host("url").alias("host"), text.registrable("url").alias("domain"))


HOST_REGISTRABLE = """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS p FROM h)
SELECT page_id, host, array_to_string(list_slice(p, CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'com', 'org', 'net', 'gov', 'ac') AND length(p[-1]) = 2 THEN -3 ELSE -2 END, -1), '.') AS domain FROM p"""


def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search results of their language: own sites first, rejected domains only where nothing else is there."""
    rows = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 40).alias("g"), "url")
    tier = filings.source_tier(F.col("url"), own=("www",), wire=("example.net",), filing=("example.org",), rejected=("example.com",))
    ranked = filings.ranked_sources(rows.withColumn("tier", tier), ["g"], "tier", "page_id")
    return ranked.select("g", "page_id", "tier", F.col("rank").cast("long").alias("rank"))


SOURCE_TIERS = """
WITH h AS (SELECT page_id, page_id % 40 AS g, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h, replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/', ' ') AS path FROM pages),
t AS (SELECT *, CASE WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 9.0 WHEN split_part(h, '.', 1) = 'www' THEN 1.0 WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 2.0 WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 3.0 ELSE 4.0 END + CASE WHEN trim(path) = '' THEN 2.5 ELSE 0.0 END AS tier FROM h),
u AS (SELECT *, count(*) FILTER (tier < 9) OVER (PARTITION BY g) AS n FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY tier, page_id) AS rank FROM u WHERE tier < 9 OR n = 0)
SELECT g, page_id, CAST(tier AS DOUBLE) AS tier, rank FROM r WHERE rank <= 4"""


def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest order of each customer that is not older than 1999 (an unknown date passes)."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("filed"), "o_orderstatus")
    dated = rows.withColumn("filed", F.when(F.col("o_orderkey") % 7 > 0, F.col("filed"))).where(dates.year_passes(F.year("filed"), 1999))
    best = filings.latest(dated, ["o_custkey"], ["filed", "o_orderkey"])
    return best.select("o_custkey", "o_orderkey", F.date_format("filed", "yyyy-MM-dd").alias("filed"), "o_orderstatus")


LATEST_FILING = """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS f, o_orderstatus FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY f DESC NULLS LAST, o_orderkey DESC) AS k FROM r WHERE f IS NULL OR year(f) >= 1999)
SELECT o_custkey, o_orderkey, strftime(f, '%Y-%m-%d') AS filed, o_orderstatus FROM k WHERE k = 1"""


def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fetched documents: the first gate that each fails."""
    p = F.col("p_partkey")
    ok, note = filings.acceptance(p % 4, F.col("p_size") * 2, F.when(p % 5 > 0, 2020 + p % 6), 2023, p % 3 > 0, p % 2 == 0, p % 7 == 0, p % 11 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", ok.alias("accepted"), note.alias("note"))


ACCEPTANCE_GATE = """
WITH p AS (SELECT p_partkey AS p, p_size * 2 AS n, p_partkey % 5 = 0 OR 2020 + p_partkey % 6 >= 2023 AS fresh, p_partkey % 3 > 0 AS bs, p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS stale FROM part),
a AS (SELECT *, p % 4 >= 2 AND n >= 40 AND fresh AND bs AND NOT stale AS ok FROM p)
SELECT p AS p_partkey, ok AS accepted, CASE WHEN ok THEN '' WHEN n < 40 THEN 'too short' WHEN NOT fresh THEN 'too old' WHEN NOT bs THEN 'no statement page' WHEN stale THEN 'interim and not recent' ELSE 'insufficient evidence' END AS note FROM a"""


def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return filings.batches(rows, ["l_suppkey"], ["l_partkey"]).groupBy("l_suppkey", F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"))


PAGE_BATCHES = """
WITH r AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1) // 12 AS batch FROM r)
SELECT l_suppkey, batch, count(*) AS pages, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL"""


def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate documents (same length and source) are suppressed, the first stays."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return filings.first_distinct(rows, ["n_chars", "source"], "doc_id")


FIRST_DOCUMENTS = """SELECT n_chars, source, min(doc_id) AS doc_id, arg_min_null(lang, doc_id) AS lang FROM documents GROUP BY n_chars, source"""


def value_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers printed in documents that equal a part's price at one of three scales."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.lit(1).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))).alias("word"))
    tokens = tokens.withColumn("token", coerce.word_number("word")).where("token is not null")
    prices = table(spark, sf_dir, "part").select(F.lit(1).alias("k"), "p_retailprice").distinct()
    met = filings.value_evidence(tokens, prices, ["k"], "token", "p_retailprice", scales=(1.0, 10.0, 1000.0))
    return met.select("doc_id", "word", "p_retailprice", "scale")


VALUE_EVIDENCE = r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)', 1)) AS word FROM documents), t AS (SELECT *, CAST(word AS DOUBLE) AS t FROM w WHERE length(word) <= 15),
p AS (SELECT DISTINCT p_retailprice, unnest([1.0, 10.0, 1000.0]) AS scale FROM part)
SELECT doc_id, word, p_retailprice, CAST(scale AS DOUBLE) AS scale FROM t JOIN p ON abs(t - abs(p_retailprice) / CAST(scale AS DOUBLE)) < 0.005 WHERE NOT (t < 10 AND t = floor(t))"""


def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = text.fold("text")
    return docs.select("doc_id", F.md5(plain).alias("digest"), F.length(text.squeeze("text")).cast("long").alias("n"))


ACCENT_FOLD = r"""
SELECT doc_id, md5(lower(translate(replace(replace(text, '’', ''''), chr(160), ' '), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'))) AS digest,
       length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS n FROM documents"""


def years_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages")
    return docs.select("page_id", dates.latest_year("html").cast("long").alias("latest"), F.size(dates.years_in("html")).cast("long").alias("n"))


YEARS_PRINTED = r"""
WITH y AS (SELECT page_id, list_filter(list_transform(list_filter(regexp_extract_all(html, '[0-9]+'), lambda n: length(n) = 4 AND (starts_with(n, '19') OR starts_with(n, '20'))), lambda n: CAST(n AS BIGINT)), lambda n: n BETWEEN 1990 AND 2100) AS y FROM pages)
SELECT page_id, list_max(y) AS latest, len(y) AS n FROM y"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier answers made of parts, read back."""
    p = F.col("p_partkey")
    said = F.concat(F.when(p % 3 == 0, "DECISION: skip\n").when(p % 3 == 1, "decision:  KEEP\n").otherwise(""), F.when(p % 2 == 0, "CONFIDENCE: High\n").otherwise(""), F.lit("REASON:  names  "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.verdict(said).alias("v")).select("p_partkey", "v.keep", "v.confidence", "v.reason")


VERDICTS = """
SELECT p_partkey, p_partkey % 3 <> 0 AS keep, CASE WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, 'names ' || p_name AS reason FROM part"""


def number_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number coercion over printed forms of parts' prices."""
    p, price = F.col("p_partkey"), F.format_number("p_retailprice", 2)
    raw = F.when(p % 6 == 0, price).when(p % 6 == 1, F.concat(F.lit("("), price, F.lit(")"))).when(p % 6 == 2, "-").when(p % 6 == 3, "n.a.").when(p % 6 == 4, "845 + 5829 - 3").otherwise(F.concat(F.lit("$"), price))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", coerce.real("raw").alias("real"), coerce.storable("raw").alias("storable"), coerce.number_or_zero("raw").alias("or_zero"), coerce.tally_number("raw").alias("tally"), coerce.cell_number("raw").alias("cell"), coerce.text_number("raw").alias("token"), coerce.word_number("raw").alias("word"), coerce.page_number("raw").alias("page"))


NUMBER_COERCIONS = """
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_retailprice AS v, p_retailprice >= 1000 AS g FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN v END AS real, CASE WHEN k = 0 AND NOT g THEN v END AS storable, CASE WHEN k = 0 AND NOT g THEN v ELSE 0 END AS or_zero, CASE k WHEN 0 THEN v WHEN 4 THEN 6671.0 WHEN 5 THEN v ELSE 0 END AS tally,
       CASE k WHEN 0 THEN v WHEN 1 THEN -v WHEN 2 THEN 0 WHEN 5 THEN v END AS cell, CASE k WHEN 0 THEN v WHEN 1 THEN -v END AS token, CASE k WHEN 0 THEN v WHEN 1 THEN v WHEN 5 THEN v END AS word, CASE k WHEN 0 THEN v WHEN 1 THEN -v END AS page FROM p"""


def json_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as answers with sums in place of numbers: the repaired text parsed, and what its values come to."""
    line = F.concat(F.lit('{"q": '), F.concat_ws(" + ", F.col("l_quantity").cast("int").cast("string"), F.concat(F.lit("-"), F.col("l_linenumber").cast("string")), F.format_number("l_extendedprice", 2)), F.lit(', "note": "1 + 2: 3", "t": '), F.concat_ws(" - ", F.col("l_partkey").cast("string"), F.concat(F.lit("-"), F.col("l_suppkey").cast("string"))), F.lit("}"))
    text = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('{"lines": ['), F.array_join(F.array_sort(F.collect_list(line)), ", "), F.lit("]}")).alias("raw"))
    fixed = coerce.once(text, parsed=F.from_json(coerce.json_sums("raw"), "lines array<struct<q double, note string, t long>>"))
    each = fixed.select("l_orderkey", F.explode_outer("parsed.lines").alias("x"))
    return each.groupBy("l_orderkey").agg(F.count("x.q").alias("n"), F.bround(F.sum("x.q"), 2).alias("q"), F.sum("x.t").alias("t"), F.count_if(F.col("x.note") == "1 + 2: 3").alias("notes"))


JSON_SUMS = """
SELECT l_orderkey, count(*) AS n, round_even(sum(CAST(l_quantity AS INTEGER) - l_linenumber + round(l_extendedprice, 2)), 2) AS q, CAST(sum(l_partkey + l_suppkey) AS BIGINT) AS t, count(*) AS notes FROM lineitem GROUP BY l_orderkey"""


def realign_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's first three words as a label, found again in the conversation's lines by a cursor that only moves forward."""
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"), "turn").select("conv_id", (F.col("turn") * 100_000 + F.col("i")).alias("line_no"), "text")
    labels = turns.select("conv_id", F.col("turn").alias("pos"), F.array_join(F.slice(F.split(F.trim(realign.as_words(F.coalesce("text", F.lit("")))), " "), 1, 3), "-").alias("label"))
    found = realign.pair(labels, lines, "conv_id")
    return found.select("conv_id", "pos", "label", "line_no", F.get("numbers", F.lit(0)).alias("value"))


REALIGN_LABELS = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
x AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM t),
n AS (SELECT conv_id, list(turn * 100000 + i ORDER BY turn, i) AS nos, list(line ORDER BY turn, i) AS lines, list(' ' || trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' ORDER BY turn, i) AS forms FROM x GROUP BY conv_id),
l AS (SELECT conv_id, turn AS pos, array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), 1, 3), '-') AS label FROM t),
k AS (SELECT conv_id, pos, label, ' ' || trim(regexp_replace(lower(label), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS w, row_number() OVER (PARTITION BY conv_id ORDER BY pos, label) AS r FROM l),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS found FROM n
    UNION ALL
    SELECT conv_id, r, CASE WHEN hit > 0 THEN cursor + hit ELSE cursor END, CASE WHEN hit > 0 THEN cursor + hit END
    FROM (SELECT w.conv_id, k.r, w.cursor, CASE WHEN length(k.w) >= 6 THEN coalesce(list_position(list_transform(list_slice(n.forms, w.cursor + 1, len(n.forms)), lambda f: contains(f, k.w)), true), 0) ELSE 0 END AS hit FROM w JOIN k ON k.conv_id = w.conv_id AND k.r = w.r + 1 JOIN n ON n.conv_id = w.conv_id)),
f AS (SELECT k.conv_id, k.pos, k.label, nos[w.found] AS line_no, lower(lines[w.found]) AS line, replace(trim(k.w), ' ', '[^\p{L}\p{N}]+') AS p FROM k JOIN w ON w.conv_id = k.conv_id AND w.r = k.r JOIN n ON n.conv_id = k.conv_id),
v AS (SELECT *, regexp_extract(regexp_extract(line, '(?:^|[^\p{L}\p{N}])' || p || '($|[^\p{L}\p{N}][^\p{L}]*)', 1), '(\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?)', 1) AS num FROM f)
SELECT conv_id, pos, label, line_no, CASE WHEN num <> '' THEN CASE WHEN starts_with(num, '(') AND ends_with(num, ')') THEN -1.0 ELSE 1.0 END * TRY_CAST(regexp_replace(replace(num, ',', ''), '^\((.*)\)$', '\1') AS DOUBLE) END AS value FROM v"""
