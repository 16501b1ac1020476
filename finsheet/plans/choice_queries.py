"""Queries over choices between documents, statement pages and landed sources, on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsheet.functions import statement
from finsheet.operators import choice
from finsheet.plans.tables import table
from finsheet.sources import readers, writers


def primary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fetched documents of a customer: primary one and runner-up, the newest interim allowed in front."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "annual").when(F.col("o_orderkey") % 50 == 0, "results").otherwise("interim").alias("kind"), F.when(F.col("o_orderkey") % 9 > 0, F.year("o_orderdate")).alias("fy"))
    return choice.primary_document(rows, ["o_custkey"], "kind", "fy", "o_orderkey", newest_interim=True).select("o_custkey", F.col("place").cast("long").alias("place"), "o_orderkey", "kind", F.col("fy").cast("long").alias("fy"))


PRIMARY_DOCUMENT = """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'annual' WHEN o_orderkey % 50 = 0 THEN 'results' ELSE 'interim' END AS kind, CASE WHEN o_orderkey % 9 > 0 THEN year(o_orderdate) END AS fy FROM orders),
a AS (SELECT *, coalesce(max(coalesce(fy, 0)) FILTER (kind = 'annual') OVER (PARTITION BY o_custkey), 0) AS ay FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN kind = 'results' THEN 0 WHEN kind = 'interim' AND coalesce(fy, 0) >= ay THEN 1 WHEN kind = 'annual' THEN 2 ELSE 3 END, fy DESC NULLS LAST, o_orderkey) AS place FROM a)
SELECT o_custkey, place, o_orderkey, kind, fy FROM p WHERE place <= 2"""


def form_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the first status, in the order P, O, F of their orders, that a customer has."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    kept = choice.first_form_with_rows(rows, ["o_custkey"], "o_orderstatus", ["P", "O", "F"])
    return kept.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


FORM_FALLBACK = """
WITH r AS (SELECT *, min(strpos('POF', o_orderstatus)) OVER (PARTITION BY o_custkey) AS m FROM orders)
SELECT o_custkey, o_orderstatus, count(*) AS n FROM r WHERE strpos('POF', o_orderstatus) = m GROUP BY ALL"""


def newest_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").cast("long").alias("fy"), "o_totalprice")
    return choice.newest_passing(rows, ["o_custkey"], "fy", "o_totalprice", F.col("o_orderkey") % 3 == 0, ["o_orderkey"], probes=4)


NEWEST_PASSING = """
WITH r AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS fy, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_totalprice DESC, o_orderkey) AS n FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS k FROM r WHERE n <= 4 AND o_orderkey % 3 = 0)
SELECT o_custkey, o_orderkey, fy, o_totalprice FROM k WHERE k = 1"""


def site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as evidence of a group's site: the domain with most backers and its confidence."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 60).alias("g"), "url", F.element_at(F.array(F.lit("wikidata"), F.lit("search"), F.lit("registry")), (F.col("page_id") % 3 + 1).cast("int")).alias("source"), (F.col("page_id") % 4).alias("tier"))
    return choice.site_evidence(rows, ["g"], "url", "source", "tier")


SITE_EVIDENCE = """
WITH h AS (SELECT page_id % 60 AS g, string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '.') AS p, ['wikidata', 'search', 'registry'][page_id % 3 + 1] AS source, page_id % 4 AS tier FROM pages),
d AS (SELECT g, array_to_string(list_slice(p, -2, -1), '.') AS domain, count(DISTINCT source) AS backers, max(tier) AS tier, bool_or(source = 'wikidata') AS a FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY backers DESC, tier DESC, domain DESC) AS k FROM d)
SELECT g, domain, backers, tier, CASE WHEN backers >= 2 OR (a AND tier = 3) THEN 'HIGH' WHEN tier >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r WHERE k = 1"""


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticker = F.substring(F.md5("url"), 1, 3)
    score = choice.site_score(F.col("url"), ticker, F.array(F.lit("exam")))
    return table(spark, sf_dir, "pages").select("page_id", score.cast("long").alias("score"))


SITE_SCORES = """
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h, lower(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path, substr(md5(url), 1, 3) AS t FROM pages)
SELECT page_id, CAST(CASE WHEN t = string_split(h, '.')[-2] THEN 10 ELSE 0 END + CASE WHEN contains(h, 'invest-' || t) THEN 8 ELSE 0 END + CASE WHEN contains(string_split(h, '.')[-2], 'exam') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(h, '^(ir|investors?)\\.') THEN 6 ELSE 0 END
     + CASE WHEN regexp_matches(path, 'invest|shareholder|/ir(/|$)') THEN 5 ELSE 0 END + CASE WHEN starts_with(url, 'https://') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(h, '(archive|legacy|old)\\.') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(path, '/(contact|privacy|terms|careers)') THEN 6 ELSE 0 END AS BIGINT) AS score FROM h"""


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("strike"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("count"), F.lit(None).cast("string").alias("life"))
    out = choice.coverage(rows, ["p_partkey"], ["strike", "count", "life"], ["strike", "life", "volatility"])
    return out.select("p_partkey", F.array_join("filled", ",").alias("filled"), F.array_join("gaps", ",").alias("gaps"))


COVERAGE_REPORT = """
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'count' END, CASE WHEN p_size > 10 THEN 'strike' END) AS filled, concat_ws(',', 'life', CASE WHEN p_size <= 10 THEN 'strike' END, 'volatility') AS gaps FROM part"""


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    out = choice.context_block(rows, ["conv_id"], "turn", "role", "text", most=300)
    return out.select("conv_id", F.length("block").cast("long").alias("n"), F.md5("block").alias("digest"))


CONTEXT_BLOCKS = """
WITH b AS (SELECT conv_id, string_agg('[' || k || '] ' || role || chr(10) || substr(text, 1, 300), chr(10) || chr(10) ORDER BY k) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id)
SELECT conv_id, length(block) AS n, md5(block) AS digest FROM b"""


def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache names, regions and vintage warnings of requests made of suppliers."""
    k = F.col("s_suppkey")
    ticker = F.when(k % 4 == 0, F.concat(F.lit(" asx:t"), k.cast("string"))).when(k % 4 == 1, "  ").when(k % 4 == 2, F.concat(F.lit("T"), k.cast("string")))
    country = F.element_at(F.array(*[F.lit(c) for c in ("France", "AUSTRALIA", "Denmark", "Japan")]), (k % 4 + 1).cast("int"))
    warned = choice.vintage_warnings((2020 + k % 6).cast("int"), F.element_at(F.array(F.lit("Annual report"), F.lit("10-Q")), (k % 2 + 1).cast("int")), 2025)
    return table(spark, sf_dir, "supplier").select("s_suppkey", choice.cache_name(ticker, F.col("s_name")).alias("key"), choice.region(country, ("france",), ("australia",), ("denmark",)).alias("region"), F.concat_ws("; ", warned).alias("warnings"))


REQUEST_KEYS = """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'T' || s_suppkey WHEN 2 THEN 'T' || s_suppkey ELSE 'name:' || lower(s_name) END AS key, ['fr', 'au', 'eu', NULL][s_suppkey % 4 + 1] AS region,
       concat_ws('; ', CASE WHEN 2020 + s_suppkey % 6 < 2024 THEN 'vintage FY' || (2020 + s_suppkey % 6) END, CASE WHEN s_suppkey % 2 = 0 THEN 'annual filing Annual report' END) AS warnings FROM supplier"""


def _statement_text(k):
    """A page with a statement in one of several forms; every fourth is a contents page or a summary."""
    number = F.format_number(F.lit(1_000_000) + k, 0)
    body = F.concat(F.lit("consolidated balance sheet (in thousands)\ncurrent assets 12,345\ntotal assets $ "), number, F.lit("\ncurrent liabilities 10,000\ntotal liabilities and equity "), number, F.lit("\ntotal equity 400,000\n"))
    own = F.concat(F.lit("en millions d'euros\nbilan consolide\ntotal de l'actif 37 825\ntotal du passif 20 100\ntotal des capitaux propres 17 725\n"))
    return F.when(k % 4 == 0, body).when(k % 4 == 1, own).when(k % 4 == 2, F.concat(F.lit("average balance sheet data\n% change\n"), body)).otherwise(F.lit("contents: balance sheet 12\nstatement of cash flows 14\nstatement of changes in equity 16\n"))


def printed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of statements printed in eight ways: grouping, languages, the order of columns, and liabilities from both together."""
    k = F.col("p_partkey")
    us, dots = F.format_number(F.lit(1_000_000) + k, 0), F.replace(F.format_number(F.lit(2_000_000) + k, 0), F.lit(","), F.lit("."))
    forms = [
        F.concat(F.lit("2024 2023\ntotal assets $ "), us, F.lit(" 9,999\ntotal liabilities 12,000 1\ntotal equity 3,000")),
        F.concat(F.lit("2023 2024\ntotal assets $ 9,999   $ "), us, F.lit("\ntotal liabilities and stockholders' equity 8,888 "), us, F.lit("\ntotal stockholders' equity 4,000 5,000")),
        F.lit("total de l'actif 37 825\ntotal du passif courant 1 000\ntotal du passif 20 100\ntotal des capitaux propres 17 725"),
        F.concat(F.lit("jumlah aset lancar 1.000\njumlah aset "), dots, F.lit("\njumlah liabilitas jangka pendek 5.000\njumlah liabilitas 6.000\njumlah ekuitas 7.000")),
        F.concat(F.lit("total assets (note 7) 12,345\nsee total assets "), us),
        F.concat(F.lit("fy2022 fy2023\ntotal assets 1,111 2,222\ntotal liabilities, redeemable stock and equity 3,333 4,444\ntotal equity 1,000 1,500")),
        F.lit("nothing here 1,234"),
        F.concat(F.lit("total actifs non courants 5 000\ntotal actif 6 000\ntotal capitaux propres et passifs 6 000\ntotal capitaux propres 2 500")),
    ]
    text = reduce(lambda held, i: held.when(k % 8 == i, forms[i]), range(1, 8), F.when(k % 8 == 0, forms[0]))
    return statement.printed_totals(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text").select("p_partkey", "assets", "liabilities", "equity")


PRINTED_TOTALS = """
WITH p AS (SELECT p_partkey, p_partkey % 8 AS k, 1000000 + p_partkey AS us FROM part)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN us WHEN 1 THEN us WHEN 2 THEN 37825 WHEN 3 THEN us + 1000000 WHEN 4 THEN us WHEN 5 THEN 2222 WHEN 7 THEN 6000 END AS BIGINT) AS assets,
       CAST(CASE k WHEN 0 THEN 12000 WHEN 1 THEN us - 5000 WHEN 2 THEN 20100 WHEN 3 THEN 6000 WHEN 5 THEN 2944 WHEN 7 THEN 3500 END AS BIGINT) AS liabilities,
       CAST(CASE k WHEN 0 THEN 3000 WHEN 1 THEN 5000 WHEN 2 THEN 17725 WHEN 3 THEN 7000 WHEN 5 THEN 1500 WHEN 7 THEN 2500 END AS BIGINT) AS equity FROM p"""


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of ten-page documents: the page of each document's statement and how well it matched."""
    k = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("doc"), (k % 10).alias("page"), F.when(k % 10 < 2, F.lit("nothing here")).otherwise(_statement_text(k)).alias("text"))
    return statement.statement_pages(pages, ["doc"], "page", "text")


STATEMENT_PAGES = """
WITH p AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS page, p_partkey % 4 AS k FROM part WHERE p_partkey % 10 >= 2 AND p_partkey % 4 IN (0, 1))
SELECT doc, min(page) AS page, 'accepted' AS match FROM p GROUP BY doc"""


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of documents of twenty: the pages about those that a contents page names."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 3, F.concat(F.lit("Contents\nConsolidated Balance Sheet ..... "), (5 + k % 17).cast("string"), F.lit("\nCash flows 9"))).otherwise(F.lit("balance sheet of no page\n12"))
    pages = table(spark, sf_dir, "part").select(F.floor(k / 20).alias("doc"), (k % 20).alias("page"), text.alias("text"), F.lit(19).cast("long").alias("last"))
    return statement.contents_ranges(pages, ["doc"], "page", "text", "balance sheet", "last")


CONTENTS_PAGES = """
WITH n AS (SELECT p_partkey // 20 AS doc, 5 + p_partkey % 17 AS n FROM part WHERE p_partkey % 20 < 10 AND p_partkey % 4 = 3), r AS (SELECT doc, unnest(range(n - 1, n + 4)) AS page FROM n)
SELECT DISTINCT doc, page FROM r WHERE page BETWEEN 0 AND 19"""


def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chosen pages of lines: text with the rows of the strict table, or of the lenient one where that has none."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag")))).alias("cells"))
    none = F.array().cast("array<array<string>>")
    pages = lines.select("l_orderkey", F.concat(F.lit("page "), F.col("l_orderkey").cast("string")).alias("text"), readers.table_cells(F.when(F.col("l_orderkey") % 3 == 0, none).when(F.col("l_orderkey") % 3 == 1, F.col("cells")), F.when(F.col("l_orderkey") % 3 < 2, F.slice("cells", 1, 1))).alias("cells"))
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return readers.selected_pages(pages, chosen, ["l_orderkey"], "text", "cells").select("l_orderkey", "text", readers.has_number(F.coalesce("cells", none)).alias("numbered"))


SELECTED_PAGES = """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_returnflag AS f FROM lineitem), r AS (SELECT l_orderkey, n || ' | ' || f AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(n AS VARCHAR), f) AS i FROM d),
c AS (SELECT l_orderkey, string_agg(r, chr(10) ORDER BY i) FILTER (l_orderkey % 3 = 1 OR (l_orderkey % 3 = 0 AND i = 1)) AS cells FROM r GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws(chr(10), 'page ' || l_orderkey, cells) AS text, false AS numbered FROM c JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'"""


def table_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read from markup and from pipe tables, counted per page."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<table><tr><th>Code</th><th>Name</th></tr><tr><td> "), k.cast("string"), F.lit("</td><td><b>A &amp; B</b></td></tr></table>")).alias("html"), F.concat(F.lit("# t\n| Code | Name |\n|---|:--|\n| "), k.cast("string"), F.lit(" | x |\nend [report](https://a.example/r.pdf) and [again](https://a.example/r.pdf)")).alias("md"))
    html = readers.html_rows(pages, ["page_id"], "html").select("page_id", F.lit("html").alias("kind"), F.col("row").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))
    pipes = readers.markdown_rows(pages, ["page_id"], "md").select("page_id", F.lit("pipes").alias("kind"), F.col("line").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))
    links = readers.markdown_links(pages, ["page_id"], "md").select("page_id", F.lit("link").alias("kind"), F.col("pos").cast("long").alias("line"), F.concat_ws("|", "anchor", "url").alias("cells"))
    return html.unionByName(pipes).unionByName(links)


TABLE_SOURCES = """
SELECT page_id, unnest(['html', 'html', 'pipes', 'pipes', 'link']) AS kind, unnest(CAST([0, 1, 1, 3, 0] AS BIGINT[])) AS line, unnest(['Code|Name', page_id || '|A &amp; B', 'Code|Name', page_id || '|x', 'report|https://a.example/r.pdf']) AS cells FROM pages"""


def archive_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest archived report by file name, and the main member of each archive."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("/archive/T"), (k % 50).cast("string"), F.lit("/FY"), F.year("o_orderdate").cast("string"), F.when(k % 3 == 0, "_annual_").otherwise("_interim_"), F.lpad(k.cast("string"), 7, "0"), F.lit(".pdf")).alias("path"))
    newest = readers.archived_reports(files, "path").select(F.col("ticker").alias("key"), F.col("path").alias("chosen"))
    members = table(spark, sf_dir, "orders").select((k % 40).cast("string").alias("key"), F.concat(F.when(k % 200 == 7, "OneReport").otherwise("doc"), k.cast("string"), F.when(k % 2 == 0, ".PDF").otherwise(".pdf")).alias("name"), "o_totalprice")
    main = readers.main_member(members, ["key"], "name", "o_totalprice").select(F.concat(F.lit("zip"), "key").alias("key"), F.col("member").alias("chosen"))
    return newest.unionByName(main)


ARCHIVE_CHOICE = """
WITH f AS (SELECT 'T' || (o_orderkey % 50) AS key, '/archive/T' || (o_orderkey % 50) || '/FY' || year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN '_annual_' ELSE '_interim_' END || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '.pdf' AS path, year(o_orderdate) AS y, o_orderkey % 3 = 0 AS a FROM orders),
m AS (SELECT 'zip' || (o_orderkey % 40) AS key, CASE WHEN o_orderkey % 200 = 7 THEN 'OneReport' ELSE 'doc' END || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS name, o_totalprice AS s FROM orders)
SELECT key, arg_max(path, (y, a, path)) AS chosen FROM f GROUP BY key UNION ALL SELECT key, arg_max(name, (contains(lower(name), 'onereport'), s, name)) FROM m GROUP BY key"""


def loose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects out of untidy answers; what cannot be read is NULL."""
    k, body = F.col("p_partkey"), F.concat(F.lit('{"n":'), F.col("p_partkey").cast("string"), F.lit(',"s":"x"'))
    said = F.when(k % 5 == 0, F.concat(body, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("}\n```\nDone"))).when(k % 5 == 2, F.concat(F.lit("Sure "), body, F.lit("} ok"))).when(k % 5 == 3, F.concat(body, F.lit(",}"))).otherwise(F.lit("no answer"))
    found = F.get_json_object(readers.loose_json(said), "$.n").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("n"))


LOOSE_ANSWERS = """SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN p_partkey END AS n FROM part"""


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested records, split to parents, children and grandchildren again: rows and sums of each."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("tranches"))
    plans = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("plan_type"), "tranches"))).alias("plans"))
    parents, children, grandchildren = writers.split_nested(plans, ["l_orderkey"])
    count = lambda df, name, total: df.agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("total"))
    return count(parents, "extraction", "l_orderkey").unionByName(count(children, "plan", "plan_index")).unionByName(count(grandchildren, "tranche", "q"))


NESTED_RECORDS = """
SELECT 'extraction' AS level, count(DISTINCT l_orderkey) AS n, CAST(sum(DISTINCT l_orderkey) AS BIGINT) AS total FROM lineitem
UNION ALL SELECT 'plan', count(*), CAST(sum(i) AS BIGINT) FROM (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS i FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem))
UNION ALL SELECT 'tranche', count(*), CAST(sum(l_quantity) AS BIGINT) FROM lineitem"""
