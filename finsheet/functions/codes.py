"""Column functions for market codes, file names, page names and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country of a country-code domain.
DOMAIN_COUNTRIES = {
    "ca": "Canada", "uk": "United Kingdom", "au": "Australia", "kr": "South Korea", "jp": "Japan", "cn": "China", "hk": "Hong Kong", "tw": "Taiwan", "in": "India",
    "id": "Indonesia", "br": "Brazil", "de": "Germany", "fr": "France", "nl": "Netherlands", "se": "Sweden", "il": "Israel", "sa": "Saudi Arabia", "sg": "Singapore", "my": "Malaysia",
    "th": "Thailand", "za": "South Africa", "mx": "Mexico", "ch": "Switzerland",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _digits(x) -> Column:
    return F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), r"\D", "")


def mainland_board(code) -> tuple[Column, Column]:
    """(board, column) of a mainland Chinese code by its first digit; anything else is Shenzhen."""
    first = F.substring(F.trim(F.coalesce(_c(code), F.lit(""))), 1, 1)
    board = F.when(first == "6", "sh").when(first.isin("4", "8", "9"), "bj").otherwise("sz")
    return board, F.when(board == "sh", "sse").when(board == "bj", "bj").otherwise("szse")


def tokyo_code(code) -> Column:
    """Five digits of a Tokyo code: four get a 0, other lengths are NULL."""
    d = _digits(code)
    return F.when(F.length(d) == 4, F.concat(d, F.lit("0"))).when(F.length(d) == 5, d)


def korea_code(code) -> Column:
    """Six digits of a Korean code, zeros in front; none or more than six digits are NULL."""
    d = _digits(code)
    return F.when(F.length(d).between(1, 6), F.lpad(d, 6, "0"))


def us_ticker(code) -> Column:
    """A ticker in capitals: a letter and up to nine letters, digits, dots or dashes; else NULL."""
    t = F.upper(F.trim(_c(code)))
    return F.when(t.rlike(r"^[A-Z][A-Z0-9.\-]{0,9}$"), t)


def id_shard(number) -> tuple[Column, Column]:
    """(first, last) id of the block of a thousand that an id lies in."""
    low = F.floor((_c(number) - 1) / 1000) * 1000 + 1
    return low.cast("long"), (low + 999).cast("long")


def domain_country(host) -> Column:
    """Country of a host by its last label, NULL for a general one."""
    table = F.create_map(*[F.lit(x) for kv in DOMAIN_COUNTRIES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.substring_index(_c(host), ".", -1)))


def country_mismatch(host, country) -> Column:
    """``domain country vs claimed country`` where both are known and differ, else NULL."""
    own = domain_country(host)
    return F.when((F.coalesce(_c(country), F.lit("")) != "") & (own != _c(country)), F.concat_ws(" vs ", own, _c(country)))


def names_us_form(file_name) -> Column:
    """Whether a file name holds 10-K, 10-Q, 20-F or 40-F as a word of its own."""
    return F.coalesce(_c(file_name), F.lit("")).rlike(r"(?i)(?<![a-z0-9])(?:10[\s_-]?[kq]|[24]0[\s_-]?f)(?![a-z0-9])")


def valid_pdf(content, pages) -> Column:
    """Whether bytes are a PDF of some size with a page in it."""
    c = _c(content)
    return F.coalesce((F.octet_length(c) >= 2000) & (F.substring(c, 1, 4) == F.encode(F.lit("%PDF"), "UTF-8")) & (_c(pages) >= 1), F.lit(False))


def display_name(raw) -> Column:
    """A page's company name: white space squeezed, cut at the first bracket or bar."""
    s = F.trim(F.regexp_replace(F.coalesce(_c(raw), F.lit("")), r"\s+", " "))
    return F.trim(F.substring_index(F.substring_index(s, "(", 1), "|", 1))


def page_company(html) -> Column:
    """Company name of a page: its first heading, else the shared title, else the title; NULL without any."""
    found = lambda pattern: F.nullif(F.regexp_extract(_c(html), pattern, 1), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_replace(F.coalesce(found(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit("")), "<[^>]+>", "")), F.lit(""))
    shared = found(r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)")
    return F.nullif(display_name(F.coalesce(heading, shared, found(r"(?is)<title[^>]*>(.*?)</title>"))), F.lit(""))


def quote_page(url) -> tuple[Column, Column]:
    """(exchange, ticker) of a quote page's address ``/stock/EXCHANGE:TICKER/...``; a bare ticker has an empty exchange."""
    token = F.trim(F.url_decode(F.nullif(F.regexp_extract(_c(url), r"(?i)/stock/([^/?#]+)", 1), F.lit(""))))
    both = F.contains(token, F.lit(":"))
    exchange = F.when(both, F.substring_index(token, ":", 1)).when(token.isNotNull(), F.lit(""))
    ticker = F.when(both, F.regexp_replace(token, "^[^:]*:", "")).otherwise(token)
    return F.upper(F.trim(exchange)), F.upper(F.trim(ticker))


def fill(template, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by its value in the given order; all other braces stay as they are."""
    out = _c(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_c(value).cast("string"), F.lit("None")))
    return out


def first_text(*columns) -> Column:
    """First text that is not blank, trimmed: the finest field that says anything."""
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in columns])


def job_label(ticker, file_name, form, source, scraped) -> tuple[Column, Column]:
    """(ticker or file stem, report label): AR for annual reports, the form without dashes, else the source."""
    name = F.coalesce(F.nullif(F.upper(F.trim(_c(ticker))), F.lit("")), F.regexp_replace(F.substring_index(F.coalesce(_c(file_name), F.lit("UNKNOWN")), "/", -1), r"(?<=.)\.[^.]*$", ""))
    f = F.upper(F.trim(F.coalesce(_c(form), F.lit(""))))
    plain = F.replace(F.replace(f, F.lit("-"), F.lit("")), F.lit("/"), F.lit("-"))
    return name, F.when(F.contains(f, F.lit("ANNUAL REPORT")) | _c(scraped), "AR").when(f != "", plain).otherwise(F.upper(F.coalesce(_c(source), F.lit("upload"))))


def search_pair(cell) -> Column:
    """(code, name) of a search hit's cell, NULL unless the code is all digits."""
    pattern = r"stock_code=(\w+)[^>]*>\s*([^<]+?)\s*<"
    code, name = F.regexp_extract(_c(cell), pattern, 1), F.regexp_extract(_c(cell), pattern, 2)
    return F.when(code.rlike(r"^\d+$"), F.struct(code.alias("code"), name.alias("name")))


def display_number(x, decimals: int = 1) -> Column:
    """A number with thousands separators, ``n/a`` where there is none."""
    return F.coalesce(F.format_number(_c(x), decimals), F.lit("n/a"))


def display_percent(x, decimals: int = 1) -> Column:
    """A fraction as per cent, ``n/a`` where there is none."""
    return F.coalesce(F.concat(F.format_number(_c(x) * 100, decimals), F.lit("%")), F.lit("n/a"))


def has_value(x) -> Column:
    """Neither NULL nor blank text."""
    return F.coalesce(F.trim(_c(x).cast("string")) != "", F.lit(False))


def any_field(*columns) -> Column:
    """Whether any of the columns holds something."""
    return F.coalesce(*[_c(c).cast("string") for c in columns]).isNotNull()


def merged_map(existing, new) -> Column:
    """Maps merged key by key: what is there and not NULL wins, NULLs of the new map are left out."""
    known, added = F.coalesce(_c(existing), F.create_map().cast("map<string,string>")), F.map_filter(_c(new), lambda _k, v: v.isNotNull())
    return F.map_zip_with(known, F.coalesce(added, F.create_map().cast("map<string,string>")), lambda _k, a, b: F.coalesce(a, b))


def progress_band(done, total, low: int = 2, high: int = 8) -> Column:
    """Progress of a part of a job within its band of the whole; NULL without a total."""
    return F.when(_c(total) > 0, low + F.floor((high - low) * _c(done) / _c(total)).cast("int"))
