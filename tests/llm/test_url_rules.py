import re

from sieveworks.llm.queries import URL_RULES, op10_url_filter
from sieveworks.llm.url_rules import judge_urls


def brute(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, pages, rules, **more):
    urls = spark.createDataFrame(pages, "page_id long, url string, html string, host string, key_host string")
    return sorted((tuple(r) for r in judge_urls(urls, spark.createDataFrame(rules, "host string, path string, verdict string"), **more).collect()), key=str)


def test_nested_rules_and_odd_urls(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/70", "block"), ("example.com", "/", "allow"), ("com", "/en/70/x/y/long", "allow"), ("a.example.com", "/é", "block")]
    urls = ["http://www.EXAMPLE.com/en/7", "https://example.com/en/70?x=/en/9", "http://com/en/", "x://y.com/en", "http://example.com", "http://example.com?q=://z", "no scheme", "", None, "a://b://c.com/en/", "http://a.example.com/éa#/x", "http://q.com/en/70/x/y/longer", "://example.com/en/71", "http://notexample.com/en/7", "HTTP://A.B.C.D.E.example.com/en/7\n0", "http://.com/en/"]
    pages = [(i, u, "h", "clash", "clash") for i, u in enumerate(urls)] * 2 + [(None, urls[0], None, None, None)]
    got = judged(spark, pages, rules + rules[:2], sweep=9)
    assert got == sorted(((p[0], *brute(p[1], rules)) for p in pages), key=str)


def test_no_rules_no_urls(spark):
    assert judged(spark, [(1, "http://a.com/x", None, None, None)], []) == [(1, "a.com", "/x", None, "allow")]
    assert judged(spark, [], URL_RULES) == []


def test_registered_query(spark, sf_dir):
    got = {r.page_id: tuple(r)[1:] for r in op10_url_filter(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    assert got == {p.page_id: brute(p.url, URL_RULES) for p in pages}
