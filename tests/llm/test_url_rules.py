import re

import pytest

from ledgermill.llm import queries, url_rules


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    "http://Example.COM/en/7x?q=1", "https://a.example.com/en/8", "http://notexample.com/en/7", "http://example.community/en/7", "http://x.net/de/", "http://example.net/de/81#f", "http://b.example.net/de/", "http://org/es/1",
    "http://foo.xyz/a.com/en/1", "http://com/en/", "http://.com/en/", "http://com", "no scheme", "", None, "http://", "a://b://com/en/", "http://example.com:80/en/7", "http://com/en/\n7", "http://É.com/en/", "http://example.com?x=/en/7",
]


@pytest.mark.parametrize("inline, broadcast", [(256, 50_000), (0, 50_000), (0, 0)])
def test_equals_plain_rules(spark, monkeypatch, inline, broadcast):
    monkeypatch.setattr(url_rules, "INLINE_RULES", inline)
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", broadcast)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, URLS[0], "x")], "page_id long, url string, verdict string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, queries.URL_RULES)).collect())
    want = [(str(i), *plain(u, queries.URL_RULES)) for i, u in [*enumerate(URLS), (3, URLS[3]), (None, URLS[0])]]
    assert sorted(want, key=str) == sorted(got, key=str)


@pytest.mark.parametrize("inline", [256, 0])
def test_rarest_token_wildcards_and_empty_tables(spark, monkeypatch, inline):
    monkeypatch.setattr(url_rules, "INLINE_RULES", inline)
    rules = [("block", "", "/private"), ("block", "example.com", "/a*/b/"), ("allow", "example.com", "/abc/b/"), ("block", "*", "/q")]
    pages = spark.createDataFrame([(1, "http://z.org/private/1"), (2, "http://example.com/axx/b/c"), (3, "http://example.com/abc/b/c"), (4, "http://example.com/q")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()}
    assert got[2] == ("example.com/a*/b/", "block") and got[3] == ("example.com/abc/b/", "allow") and got[4] == (None, "allow")  # a star in a host is no wildcard
    assert got[1] == (None, "allow")  # an empty host is that of no URL with a host
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, [])).collect()} == {"allow"}
