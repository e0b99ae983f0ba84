"""URL filter: the trie and the join against a plain walk over all rules."""

import random

import pytest

from lexiflow.llm import urlfilter
from lexiflow.llm.queries import URL_RULES


def slow(url, rules):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in rules:
        h, p = urlfilter.parse_rule(rule)
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(rule), len(h), verdict == "block")
            if best is None or rank > best[0]:
                best = rank, rule, verdict
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [None, "", "nothing", "://", "http://", "HTTP://Blog.Example.COM/en/71?x", "http://example.com/en/", "https://com/en/7", "http://xexample.com/en/7", "http://a.net/de/8", "http://a.example.net/de/88#t", "http://example.org?/es/", "http://user@b.org:80/es/", "http://a.org/es/x", "http://é.org/es/ü\n", "x://y://z.com/en/", "http://a..com//en/", "http://com./en/"]
MANY = [*URL_RULES, ("block", "b.org/"), ("allow", "b.org"), ("block", "a.net/de/8"), ("allow", "a.net/de/8"), ("block", "/es/x"), ("allow", "COM/en/7/x"), ("allow", "net/de/8 is long"), ("block", "org/es/x/"), ("allow", "a.org/es/"), ("block", "b.com/"), ("allow", "com/de/")]


@pytest.mark.parametrize("rules", [URL_RULES, MANY, []])
@pytest.mark.parametrize("most", [urlfilter.MAX_TRIE_RULES, -1])
def test_both_ways_equal_a_walk(spark, rules, most):
    if most < 0 and not rules:
        return
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    urls = URLS + [f"http://{pick('a.', '', 'b.c.')}{pick('example.', 'a.', 'b.')}{pick('com', 'net', 'org')}{pick('', '/', '/en/', '/de/8', '/en/7x', '/es/x/y')}{pick('', '?q', '#f', '/z')}" for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(urls + urls[:5])), "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as rule")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.filter_urls(df, rules, max_trie_rules=most).collect()}
    assert got == {k: slow(u, rules) for k, u in enumerate(urls + urls[:5])}
    assert urlfilter.filter_urls(df.limit(0), rules or URL_RULES, max_trie_rules=most).count() == 0
