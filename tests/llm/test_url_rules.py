import re
from collections import Counter

from langmix.llm.queries import URL_RULES
from langmix.llm.url_rules import judge_urls, rule_table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Net/x?y#z", "http://planet/x", "http://www.example.net/en/1", "http://example.net/en",
        "http://example.net.org/fr/1", "http://x.y.example.com/de/", "http://example.com/DE/", "http://org/fr/a", "http://a-b.org?fr/", "http://a.org#/fr/", "http://a.org/fr/?q",
        "a://b://c/d", "http://net./x", "http://.net/x", "http://ex ample.net/\n/x", "http://user@a.net:80/x", "http://é.net/x", "http://example.net/en/", "http://net/"]


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = judge_urls(pages, rule_table(spark, rules))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}


def test_matches_brute_force(spark):
    more = URL_RULES + [("block", "a.net", "/x/"), ("allow", "y.a.net", "/"), ("block", "com", "/"), ("allow", "example.com", "/"), ("block", "x.example.com", "/de/a")]
    urls = URLS + [f"http://{h}{p}" for h in ("a.net", "b.a.net", "y.a.net", "z.y.a.net", "aa.net", "a-b.net", "example.com", "x.example.com", "w.x.example.com", "examplex.com") for p in ("", "/", "/x/1", "/de/", "/de/a")]
    for rules in (URL_RULES, more, more + more):
        assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_hot_host_and_repeated_rows(spark):
    urls = ["http://blog.example.net/en/1"] * 500 + URLS * 3
    assert run(spark, urls, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}


def test_conflicting_rules_block(spark):
    assert Counter(v[3] for v in run(spark, ["http://net/"], [("allow", "net", "/"), ("block", "net", "/")]).values()) == {"block": 1}


def test_empty_tables(spark):
    assert run(spark, [], URL_RULES) == {}
    assert run(spark, ["http://net/"], []) == {0: ("net", "/", None, "allow")}
