"""URL filters against every rule tried on every URL."""

from __future__ import annotations

import random

import pytest

from finsheet.llm.url_filters import RULE, allowed_only, judged

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("example.com", "/en/a", "allow"),
    ("Example.COM", "/private", "block"), ("a.b.example.com", "", "block"), ("org", "/x/y/z/", "block"), ("org", "/x/y/z/", "allow"), ("", "/", "block"), (None, "/", "block"), ("com", None, "block"),
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, signs: min([len(s), *(s.index(c) for c in signs if c in s)])
    host = rest[: cut(rest, "/?#")]
    path = rest[len(host) :]
    return "".join(c.lower() if c.isascii() else c for c in host), path[: cut(path, "?#")]


def brute(url):
    host, path = parse(url)
    fits = []
    for h, p, v in RULES:
        if h is not None and p is not None:
            h = h.lower()
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h) + len(p), len(h), v, h + p))
    _, _, verdict, rule = max(fits, default=(0, 0, "allow", None))
    return host, path, rule, verdict


URLS = [
    None, "", "example.com/en/", "http://", "http://EXAMPLE.com", "http://example.com/", "http://www.example.com/en/1", "http://m.example.com/en/1?x=/es/", "http://badexample.com/en/1",
    "https://a.net/es/1#top", "https://a.net/es", "https://net/es/", "ftp://user:p@x.com:80/a", "http://example.com/en/abc", "http://example.com/privately", "http://q.a.b.example.com", "http://x.org/x/y/z/1",
    "http://x.org/x/y/z", "http://É.com/é/", "a://b://c.com/", "http:///", "http://.com/", "http://a..com/en/", "http://x.com/" + "a/" * 40_000, "http://" + "a." * 20_000 + "net/es/", "http://a.net\n/es/\n/x",
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    made = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'a.b.', 'M.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/', '/en/', '/es/', '/x/y/z/', '/en/a', '/private'])}{rng.choice(['', 'q', '/z', '?a=/en/', '#/es/'])}" for _ in range(400)]
    urls = [*URLS, *made, *["http://hot.example.com/en/1"] * 300]
    return spark.createDataFrame([(i, u, i % 3, "p") for i, u in enumerate(urls)], "page_id long, url string, host int, path string").repartition(5).cache()


def test_against_every_rule(spark, pages):
    rows = {r.page_id: tuple(r)[1:] for r in judged(pages, spark.createDataFrame(RULES, RULE)).collect()}
    want = {r.page_id: brute(r.url) for r in pages.select("page_id", "url").collect()}
    assert rows == want


def test_no_python_runs(spark, pages, capsys):
    judged(pages, spark.createDataFrame(RULES, RULE)).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_blocked_pages_go(spark, pages):
    left = allowed_only(pages, spark.createDataFrame(RULES, RULE))
    assert left.columns == pages.columns
    assert sorted(r.page_id for r in left.collect()) == sorted(r.page_id for r in pages.collect() if brute(r.url)[3] == "allow")


def test_repeated_and_empty_tables(spark, pages):
    rules = spark.createDataFrame(RULES, RULE)
    twice = spark.createDataFrame([(1, "http://a.net/es/1"), (1, "http://a.net/es/1"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in judged(twice, rules).collect()) == [(0, None, "allow"), (1, "net/es/", "block"), (1, "net/es/", "block")]
    assert judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judged(pages, rules.limit(0)).collect()} == {"allow"}
