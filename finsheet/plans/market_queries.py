"""Market rules over the driver tables: orders stand for landed filings and attachments of their customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.functions import codes, coerce, dates, maps, text
from finsheet.operators import choice, facts, markets, merge, plans, resolve, state
from finsheet.plans.tables import table

_FORMS = ("10-K", "10-Q", "8-K", "120", "160", "A001", "40-F")
_KINDS = ("application/pdf", "application/xhtml+xml", "image/tiff", "text/csv")
_TITLES = (
    "2023年年度报告", "2023年年度报告摘要", "2023年年度报告（英文版）", "Annual Report 2023", "Interim Report 2023", "Annual Report Summary", "Audited Financial Statements 2023 (English).pdf",
    "FinancialStatement-2023-Tahunan-ABCD.pdf", "AnnualReport-2023-ABCD-att1.pdf", "AnnualReport-2023-ABCD-att2.pdf", "Surat pengantar.pdf", "ESG report.pdf", "LK ABCD 2023.pdf", "Quarterly results Q1 2024", "Corporate governance report.pdf",
    "Periodic report 31.12.2023 consolidated financial", "results-20240331.pdf",
)
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _nth(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company"), key.alias("doc"), F.when(key % 13 != 0, F.to_date("o_orderdate")).alias("filed"), F.year("o_orderdate").alias("year"),
        _nth(_FORMS, key).alias("form"), _nth(_KINDS, key).alias("kind"), _nth(_TITLES, key).alias("title"), F.col("o_totalprice").alias("price"),
    )


_FILINGS = f"""
    SELECT o_custkey AS company, o_orderkey AS doc, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed, CAST(year(o_orderdate) AS INTEGER) AS year,
           {_LIST(_FORMS)}[o_orderkey % {len(_FORMS)} + 1] AS form, {_LIST(_KINDS)}[o_orderkey % {len(_KINDS)} + 1] AS kind, {_LIST(_TITLES)}[o_orderkey % {len(_TITLES)} + 1] AS title, o_totalprice AS price FROM orders"""


def form_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest filing among the forms of three markets."""
    rows, out = _filings(spark, sf_dir), None
    for market in ("us", "jp_interim", "kr"):
        own = markets.newest_of_forms(rows, ["company"], "form", markets.FORMS[market], "filed", "doc").select(F.lit(market).alias("market"), "company", "doc", "form")
        out = own if out is None else out.unionByName(own)
    return out


FORM_CHOICE = f"""
WITH f AS ({_FILINGS}), m AS (SELECT *, CASE WHEN form IN ('10-K', '10-Q') THEN 'us' WHEN form IN ('120', '160') THEN 'jp_interim' WHEN form = 'A001' THEN 'kr' END AS market FROM f)
SELECT market, company, doc, form FROM (SELECT *, row_number() OVER (PARTITION BY market, company ORDER BY filed DESC NULLS LAST, doc) AS i FROM m WHERE market IS NOT NULL) WHERE i = 1"""


def format_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year of a company (a publication) the document in the best format of two markets."""
    rows, out = _filings(spark, sf_dir).withColumn("filed", F.make_date("year", F.lit(12), F.lit(31))), None
    for market in ("dk", "uk"):
        own = markets.best_format(rows, ["company"], "filed", "kind", markets.FORMATS[market], "doc").select(F.lit(market).alias("market"), "company", "doc", "kind")
        out = own if out is None else out.unionByName(own)
    return out


FORMAT_CHOICE = f"""
WITH f AS ({_FILINGS}), p AS (SELECT 'dk' AS market, {_LIST(markets.FORMATS["dk"])} AS best UNION ALL SELECT 'uk', {_LIST(markets.FORMATS["uk"])})
SELECT market, company, doc, kind FROM (SELECT *, row_number() OVER (PARTITION BY market, company ORDER BY year DESC, coalesce(list_position(best, kind), 99), doc) AS i FROM f, p) WHERE i = 1"""


def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each market's rules say of every title."""
    score = {f"score_{m}": markets.attachment_score("title", m).cast("long") for m in ("il", "my", "id")}
    rows = _filings(spark, sf_dir).select("doc", markets.full_annual("title", "cn").alias("annual_cn"), markets.full_annual("title", "hk").alias("annual_hk"), *[c.alias(n) for n, c in score.items()], markets.name_stamp("title").cast("long").alias("stamp"), codes.names_us_form(F.concat(F.lit("x_"), "form", F.lit(".pdf"))).alias("us_form"))
    return rows


TITLE_RULES = f"""
SELECT doc, title = '2023年年度报告' AS annual_cn, title = 'Annual Report 2023' AS annual_hk,
       CAST(CASE title WHEN 'Annual Report 2023' THEN 70 WHEN 'Annual Report Summary' THEN -100 WHEN 'Interim Report 2023' THEN -100 WHEN 'Quarterly results Q1 2024' THEN -100 WHEN 'ESG report.pdf' THEN -100
            WHEN 'Audited Financial Statements 2023 (English).pdf' THEN 50 WHEN 'Periodic report 31.12.2023 consolidated financial' THEN 110 WHEN 'AnnualReport-2023-ABCD-att1.pdf' THEN 70 WHEN 'AnnualReport-2023-ABCD-att2.pdf' THEN 70
            WHEN 'Surat pengantar.pdf' THEN 0 WHEN 'Corporate governance report.pdf' THEN 0 ELSE 10 END AS BIGINT) AS score_il,
       CAST(CASE WHEN title NOT LIKE '%.pdf' THEN -1000 WHEN title IN ('ESG report.pdf', 'Corporate governance report.pdf') THEN -100 WHEN title LIKE 'Audited%' THEN 60 ELSE 0 END AS BIGINT) AS score_my,
       CAST(CASE WHEN title LIKE '%ESG%' THEN -100 WHEN title LIKE 'Surat%' THEN -50 WHEN title LIKE 'Audited%' THEN 125 WHEN title LIKE 'LK %' THEN 55 WHEN title LIKE 'FinancialStatement-%' THEN 25 WHEN title LIKE 'AnnualReport%' THEN 5 ELSE 0 END AS BIGINT) AS score_id,
       CAST(CASE WHEN title LIKE 'results%' THEN 20240331 ELSE 0 END AS BIGINT) AS stamp, form IN ('10-K', '10-Q', '40-F') AS us_form FROM ({_FILINGS})"""


def attachment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indonesian rule: one document of statements, else the parts of the annual report in order."""
    part = F.nullif(F.regexp_extract(F.lower("title"), r"annualreport.*att(\d+)", 1), F.lit("")).try_cast("int")
    rows = _filings(spark, sf_dir).select("company", "year", "doc", "title", markets.attachment_score("title", "id").alias("score"), part.alias("part"))
    return markets.best_or_parts(rows, ["company", "year"], "score", "part", "doc").select("company", "year", "doc", F.col("turn").cast("long").alias("turn"))


ATTACHMENT_CHOICE = f"""
WITH s AS (SELECT company, year, doc, CASE WHEN title LIKE '%ESG%' THEN -100 WHEN title LIKE 'Surat%' THEN -50 WHEN title LIKE 'Audited%' THEN 125 WHEN title LIKE 'LK %' THEN 55 WHEN title LIKE 'FinancialStatement-%' THEN 25 WHEN title LIKE 'AnnualReport%' THEN 5 ELSE 0 END AS score,
                  CASE WHEN title LIKE '%att1.pdf' THEN 1 WHEN title LIKE '%att2.pdf' THEN 2 END AS part FROM ({_FILINGS})),
r AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY score DESC, doc) AS i, max(score) OVER g AS top, count(part) OVER g AS parts FROM s WINDOW g AS (PARTITION BY company, year))
SELECT company, year, doc, row_number() OVER (PARTITION BY company, year ORDER BY coalesce(part, 0), doc) AS turn FROM r WHERE CASE WHEN top >= 25 OR parts = 0 THEN i = 1 ELSE part IS NOT NULL END"""


def newest_year_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the newest year that a company has any of, not older than five years."""
    return markets.newest_year(_filings(spark, sf_dir).select("company", "year", "doc"), ["company"], "year", 1998, 3)


NEWEST_YEAR_DOCS = f"""
WITH f AS (SELECT * FROM ({_FILINGS}) WHERE year BETWEEN 1995 AND 1998) SELECT company, year, doc FROM (SELECT *, max(year) OVER (PARTITION BY company) AS top FROM f) WHERE year = top"""


def newest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European rule: newest period, then the one added last, then fewest errors; nothing that is too old."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("doc"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period_end"), F.to_date("o_orderdate").alias("added"), F.col("o_orderkey").alias("errors"))
    return markets.newest_release(rows, ["company"], "period_end", "added", "errors", 1997).select("company", "doc")


NEWEST_RELEASE = """
SELECT o_custkey AS company, o_orderkey AS doc FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, CAST(o_orderdate AS DATE) DESC, o_orderkey) AS i FROM orders) WHERE i = 1 AND year(o_orderdate) >= 1997"""


def exhibit_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and language the text in which the terms occur most often, of equal ones the longest; how many different ones it has."""
    terms = ("an", "the ", "re", "license")
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text")
    best = markets.best_exhibit(rows, ["source", "lang"], "text", "doc_id", terms)
    return best.select("source", "lang", "doc_id", F.col("score").cast("long").alias("score"), markets.term_hits("text", terms).cast("long").alias("kinds"))


EXHIBIT_CHOICE = """
WITH c AS (SELECT source, lang, doc_id, length(coalesce(text, '')) AS n, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT *, len(string_split(t, 'an')) + len(string_split(t, 'the ')) + len(string_split(t, 're')) + len(string_split(t, 'license')) - 4 AS score,
             CAST(contains(t, 'an') AS INT) + CAST(contains(t, 'the ') AS INT) + CAST(contains(t, 're') AS INT) + CAST(contains(t, 'license') AS INT) AS kinds FROM c)
SELECT source, lang, doc_id, CAST(score AS BIGINT) AS score, CAST(kinds AS BIGINT) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, n DESC, doc_id) AS i FROM s) WHERE i = 1"""


def exhibit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibits with the award note where the first document of a company lacks it."""
    note = "The weighted-average exercise\n price of awards granted, exercised and forfeited"
    text = F.when(F.col("o_orderkey") % 5 < 2, note).when(F.col("o_orderkey") % 5 == 2, "granted and vested, no price").otherwise("weighted average grant-date fair value of awards")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("doc"), text.alias("text"), F.concat(F.element_at(F.array(F.lit("ex"), F.lit("R"), F.lit("FilingSummary")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ".txt").otherwise(".htm")).alias("name"))
    first = rows.groupBy("company").agg(F.min("doc").alias("first"))
    rows = rows.join(first, "company").withColumn("primary", F.col("doc") == F.col("first"))
    return markets.exhibits_to_append(rows, ["company"], "name", "primary", "text", "doc").select("company", "doc", F.col("turn").cast("long").alias("turn"))


EXHIBIT_APPEND = """
WITH o AS (SELECT o_custkey AS company, o_orderkey AS doc, o_orderkey % 5 < 2 AS note, o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AS page, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders),
l AS (SELECT company FROM o WHERE first AND NOT note),
p AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY doc) AS i FROM o WHERE NOT first AND page AND company IN (SELECT company FROM l)),
n AS (SELECT company, doc, row_number() OVER (PARTITION BY company ORDER BY doc) AS turn FROM p WHERE i <= 30 AND note)
SELECT * FROM n WHERE turn <= 2"""


def result_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a company's result documents are tried."""
    rows = _filings(spark, sf_dir).select("company", "doc", "title", "year", "price")
    ranked = markets.ranked_results(rows, ["company"], F.lower("title").rlike("results|interim"), F.lower("title").rlike("quarterly"), "title", "year", "price", "doc")
    return ranked.select("company", "doc", F.col("turn").cast("long").alias("turn"))


RESULT_RANKING = f"""
SELECT company, doc, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN title LIKE 'results%' OR title LIKE 'Interim%' THEN 0 WHEN title LIKE 'Quarterly%' THEN 1 ELSE 2 END,
       CASE WHEN title LIKE 'results%' THEN 20240331 ELSE 0 END DESC, year DESC, price DESC, doc) AS turn FROM ({_FILINGS})"""


def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best priority of each customer by the price of an order, and the next best one's price."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.floor("o_totalprice").cast("long").alias("score"))
    return markets.best_and_runner_up(rows, ["o_custkey"], "o_orderpriority", "score")


RUNNER_UP = """
WITH o AS (SELECT o_custkey, o_orderpriority, CAST(max(floor(o_totalprice)) AS BIGINT) AS score FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderpriority) AS i FROM o)
SELECT o_custkey, max(o_orderpriority) FILTER (i = 1) AS best, max(score) FILTER (i = 1) AS score, coalesce(max(score) FILTER (i = 2), 0) AS runner_up FROM r GROUP BY o_custkey"""


def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's page names it: by ticker, by a longer token of its name, by a similar title, or not known."""
    key = F.col("p_partkey")
    text = F.when(key % 5 != 4, F.concat_ws(" ", F.lit("Welcome to"), F.when(key % 3 == 0, F.col("p_brand")), F.when(key % 2 == 0, F.col("p_name"))))
    status = F.when(key % 7 == 0, 404).otherwise(200)
    return table(spark, sf_dir, "part").select("p_partkey", markets.page_verified(status, text, F.col("p_brand"), F.split(F.lower("p_name"), " "), F.when(key % 11 == 0, 80)).alias("verified"))


PAGE_CHECKS = """
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 4 THEN p_partkey % 3 = 0 OR p_partkey % 11 = 0
       OR (p_partkey % 2 = 0 AND len(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) >= 4 AND t <> lower(p_brand))) > 0)
       OR len(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) >= 4 AND t <> lower(p_brand) AND contains('welcome to', t))) > 0 END AS verified FROM part"""


def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market forms of part numbers, and the small text helpers, row by row."""
    key = F.col("p_partkey")
    number = F.concat(key.cast("string"), F.lit(".KS"))
    board, column = codes.mainland_board(key.cast("string"))
    low, high = codes.id_shard("p_partkey")
    exchange, ticker = codes.quote_page(F.concat(F.lit("https://x.example/stock/"), F.when(key % 2 == 0, "osl:").otherwise(""), F.lit("ab"), key.cast("string"), F.lit("/summary?x=1")))
    name, label = codes.job_label(F.when(key % 3 == 0, F.concat(F.lit(" tk"), key.cast("string"))), F.concat(F.lit("/in/file"), key.cast("string"), F.lit(".pdf")), F.when(key % 4 == 0, "10-K/A").when(key % 4 == 1, "Annual report"), F.lit("upload"), key % 9 == 0)
    host = F.element_at(F.array(F.lit("www.a.co.uk"), F.lit("b.com"), F.lit("c.de")), (key % 3 + 1).cast("int"))
    filled = codes.fill(F.lit("{{a}} {a} {b} {c}"), {"a": key, "b": F.lit(None).cast("string")})
    pair = codes.search_pair(F.concat(F.lit("<a href='?stock_code="), F.when(key % 2 == 0, key.cast("string")).otherwise("X1"), F.lit("' class='l'> "), "p_brand", F.lit(" <")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", board.alias("board"), column.alias("plate"), codes.tokyo_code(key).alias("tokyo"), codes.korea_code(number).alias("korea"), codes.us_ticker(F.col("p_brand")).alias("us"), low.alias("shard_low"), high.alias("shard_high"), exchange.alias("exchange"),
        ticker.alias("ticker"), name.alias("job"), label.alias("label"), codes.country_mismatch(host, F.when(key % 2 == 0, "Germany")).alias("mismatch"), filled.alias("filled"), pair["code"].alias("hit_code"), pair["name"].alias("hit_name"),
        codes.first_text(F.when(key % 5 == 0, F.col("p_name")), F.when(key % 5 == 1, F.lit("  ")), F.col("p_type")).alias("field"), codes.display_number(F.when(key % 6 != 0, F.col("p_retailprice")), 1).alias("shown"),
        codes.display_percent(F.when(key % 6 != 0, key / 1000), 1).alias("percent"), codes.progress_band(key % 10, F.when(key % 8 != 0, F.lit(10)).otherwise(0)).cast("long").alias("progress"),
        codes.has_value(F.when(key % 5 == 1, F.lit(" ")).when(key % 5 == 2, F.lit("x"))).alias("has_value"), codes.any_field(F.when(key % 5 == 1, F.lit(" ")), F.when(key % 5 == 2, F.lit("x"))).alias("any_field"),
        codes.valid_pdf(F.encode(F.concat(F.when(key % 2 == 0, "%PDF").otherwise("<htm"), F.repeat(F.lit("x"), F.when(key % 3 == 0, 1000).otherwise(2000))), "UTF-8"), (key % 5).cast("int")).alias("pdf"),
    )


CODE_FORMS = """
WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT p_partkey, CASE WHEN k[1] = '6' THEN 'sh' WHEN k[1] IN ('4', '8', '9') THEN 'bj' ELSE 'sz' END AS board, CASE WHEN k[1] = '6' THEN 'sse' WHEN k[1] IN ('4', '8', '9') THEN 'bj' ELSE 'szse' END AS plate,
       CASE length(k) WHEN 4 THEN k || '0' WHEN 5 THEN k END AS tokyo, CASE WHEN length(k) <= 6 THEN lpad(k, 6, '0') END AS korea, CASE WHEN regexp_full_match(upper(trim(p_brand)), '[A-Z][A-Z0-9.\\-]{0,9}') THEN upper(trim(p_brand)) END AS us,
       CAST(floor((p_partkey - 1) / 1000) * 1000 + 1 AS BIGINT) AS shard_low, CAST(floor((p_partkey - 1) / 1000) * 1000 + 1000 AS BIGINT) AS shard_high, CASE WHEN p_partkey % 2 = 0 THEN 'OSL' ELSE '' END AS exchange, 'AB' || k AS ticker,
       CASE WHEN p_partkey % 3 = 0 THEN 'TK' || k ELSE 'file' || k END AS job, CASE WHEN p_partkey % 4 = 1 OR p_partkey % 9 = 0 THEN 'AR' WHEN p_partkey % 4 = 0 THEN '10K-A' ELSE 'UPLOAD' END AS label,
       CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'United Kingdom vs Germany' END AS mismatch, '{' || k || '} ' || k || ' None {c}' AS filled, CASE WHEN p_partkey % 2 = 0 THEN k END AS hit_code, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS hit_name,
       CASE WHEN p_partkey % 5 = 0 THEN trim(p_name) ELSE trim(p_type) END AS field, CASE WHEN p_partkey % 6 = 0 THEN 'n/a' ELSE format('{:,.1f}', round_even(p_retailprice, 1)) END AS shown, CASE WHEN p_partkey % 6 = 0 THEN 'n/a' ELSE format('{:,.1f}', p_partkey / 10) || '%' END AS percent,
       CASE WHEN p_partkey % 8 <> 0 THEN CAST(2 + 6 * (p_partkey % 10) // 10 AS BIGINT) END AS progress, p_partkey % 5 = 2 AS has_value, p_partkey % 5 IN (1, 2) AS any_field, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 >= 1 AS pdf FROM p"""


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company name of every raw page."""
    return table(spark, sf_dir, "pages").select("page_id", codes.page_company("html").alias("name"))


PAGE_NAMES = r"""
WITH p AS (SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS h, nullif(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']+)', 1), '') AS o,
                  nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS t FROM pages)
SELECT page_id, nullif(trim(string_split(string_split(trim(regexp_replace(coalesce(h, o, t, ''), '\s+', ' ', 'g')), '(')[1], '|')[1]), '') AS name FROM p"""


def nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of all lines of an order merged in their order: what an earlier one has stands."""
    least = F.min_by(F.struct("l_returnflag", "l_linestatus", "l_suppkey"), F.struct("l_partkey", "l_suppkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(least.alias("x"))
    entry = F.create_map(F.lit("flag"), F.when(F.col("x.l_returnflag") != "N", F.col("x.l_returnflag")), F.lit("status"), F.col("x.l_linestatus"), F.concat(F.lit("mode"), F.col("l_linenumber").cast("string")), F.col("x.l_suppkey").cast("string"))
    lines = rows.groupBy("l_orderkey").agg(merge.in_order(F.collect_list(F.struct(F.col("l_linenumber").alias("o"), entry.alias("r")))).alias("maps"))
    merged = F.aggregate(F.slice("maps", 2, F.size("maps")), F.get("maps", F.lit(0)), codes.merged_map)
    return lines.select("l_orderkey", merged.alias("m")).select("l_orderkey", F.size("m").cast("long").alias("n"), *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("flag", "status", "mode1", "mode2", "mode7")])


NESTED_MERGE = """
WITH r AS (SELECT l_orderkey, l_linenumber AS n, arg_min({'f': CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 's': l_linestatus, 'm': CAST(l_suppkey AS VARCHAR)}, (l_partkey, l_suppkey, l_quantity)) AS x FROM lineitem GROUP BY ALL)
SELECT l_orderkey, 2 + count(*) AS n, arg_min(x.f, n) FILTER (x.f IS NOT NULL) AS flag, arg_min(x.s, n) FILTER (x.s IS NOT NULL) AS status, max(x.m) FILTER (n = 1) AS mode1, max(x.m) FILTER (n = 2) AS mode2, max(x.m) FILTER (n = 7) AS mode7 FROM r GROUP BY l_orderkey"""


def classifier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a filing as the classifier left them; where it failed five times all candidates are kept."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("keep"))
    return state.keep_all_on_failures(rows, ["user_id"], "failed", "keep").select("user_id", "event_id", "keep", "reason")


CLASSIFIER_FALLBACK = """
SELECT user_id, event_id, n >= 5 OR event_type = 'purchase' AS keep, CASE WHEN n >= 5 THEN 'classifier-down' END AS reason FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS n FROM events)"""


_NAMES = ("Acme Holdings PLC", "Beta & Sons, Inc.", "Gamma Ltd", "Delta")
_MEMBERS = ("us-gaap:RestrictedStockMember", "x:LongTermIncentive2024PlanMember", "Plain")
_AMOUNTS = ("12", " 3.7 ", "1,200", "n/a", "yes", "$ 12 + 3", "about 12", "-")
_MONEY = ("US$", "€", "₩", "S$", "FURLONG", "YEN")


def helper_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, members, amounts, currencies, years and dates of small forms, picked by key, through the small helpers."""
    key = F.col("p_partkey")
    amount, first = _nth(_AMOUNTS, key), F.when(key % 3 == 0, key % 2)
    lei = F.concat(F.lpad(key.cast("string"), 18, "A"), F.when(key % 2 == 0, "42").otherwise("4X"))
    second = choice.keep_second_pass(F.array(F.lit(1), F.lit(2)), F.when(key % 4 < 3, F.sequence(F.lit(1), (key % 4 + 1).cast("int"))).otherwise(F.array(F.lit(9))))
    day = lambda s: F.lit(s).cast("date")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.strip_legal(_nth(_NAMES, key)).alias("name"), text.member_label(_nth(_MEMBERS, key)).alias("member"), text.is_lei(lei).alias("lei"), dates.roc_year((key % 200 + 1911).cast("int")).cast("long").alias("roc"),
        dates.is_fresh(F.date_sub(day("2025-06-30"), (key % 400).cast("int")), day("2025-06-30")).alias("fresh"), coerce.storable_int(amount).cast("long").alias("whole"), coerce.storable_bool(amount).alias("flag"), coerce.tally_warning(amount).alias("warning"),
        coerce.truthy(first, key % 5).cast("long").alias("truthy"), maps.mapped(_nth(_MONEY, key), maps.CURRENCIES).alias("currency"), F.size(second).cast("long").alias("plans"),
    )


HELPER_FORMS = """
SELECT p_partkey, ['Acme Holdings', 'Beta & Sons', 'Gamma', 'Delta'][p_partkey % 4 + 1] AS name, ['Restricted Stock', 'Long Term Incentive2024 Plan', 'Plain'][p_partkey % 3 + 1] AS member, p_partkey % 2 = 0 AS lei, p_partkey % 200 AS roc, p_partkey % 400 <= 280 AS fresh,
       [12, 3, NULL, NULL, NULL, NULL, NULL, NULL][p_partkey % 8 + 1] AS whole, CASE WHEN p_partkey % 8 = 4 THEN TRUE END AS flag, CASE p_partkey % 8 WHEN 3 THEN 'unreadable amount: n/a' WHEN 4 THEN 'unreadable amount: yes' WHEN 6 THEN 'unreadable amount: about 12' END AS warning,
       CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 1 ELSE p_partkey % 5 END AS truthy, ['USD', 'EUR', 'KRW', 'SGD', NULL, 'JPY'][p_partkey % 6 + 1] AS currency, [2, 2, 3, 2][p_partkey % 4 + 1] AS plans FROM part"""


def domain_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate domains that score well and are not on the block list."""
    host = F.concat(F.lit("site"), (F.col("p_partkey") % 50).cast("string"), F.lit(".example"))
    candidates = table(spark, sf_dir, "part").select("p_partkey", host.alias("domain"), (F.col("p_size") * 2).alias("score"))
    blocked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("site"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".example")).alias("domain"))
    return resolve.suggest_domains(candidates, blocked, "score", "domain").select("p_partkey", "domain", F.col("score").cast("long").alias("score"))


DOMAIN_SUGGESTIONS = """
SELECT p_partkey, 'site' || p_partkey % 50 || '.example' AS domain, CAST(p_size * 2 AS BIGINT) AS score FROM part WHERE p_size * 2 >= 75 AND p_partkey % 50 NOT IN (SELECT s_suppkey * 3 FROM supplier)"""


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an order's lines, 0 where nothing is filled."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("granted"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).alias("lapsed"))
    return plans.totals(rows, ["l_orderkey"], ["granted", "lapsed"])


PLAN_TOTALS = """
SELECT l_orderkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total_granted, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS total_lapsed FROM lineitem GROUP BY l_orderkey"""


def closing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings worth reading: those with a share count at an instant near their report date."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("filing"), F.when(F.col("o_orderkey") % 4 == 0, "x:OptionsOutstandingNumber").when(F.col("o_orderkey") % 4 == 1, "x:NonvestedNumber").otherwise("x:Revenue").alias("concept"), F.to_date("o_orderdate").alias("period_instant"))
    filings = rows.groupBy("filing").agg(F.max("period_instant").alias("period_of_report"))
    return facts.with_closing_counts(rows, filings).select("filing")


CLOSING_COUNTS = """
WITH f AS (SELECT o_custkey AS filing, max(CAST(o_orderdate AS DATE)) AS r FROM orders GROUP BY 1)
SELECT DISTINCT filing FROM f JOIN orders ON o_custkey = filing WHERE o_orderkey % 4 IN (0, 1) AND abs(date_diff('day', CAST(o_orderdate AS DATE), r)) <= 15"""
