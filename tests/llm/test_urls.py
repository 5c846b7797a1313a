import re

from tidewatch.llm.urls import RULES, TERMS, judge_urls

URLS = [
    None, "", "no scheme", "http://a.example.com/en/7x?q=1", "https://EXAMPLE.com/en/8", "http://example.com/en/77", "http://x.net/de/1", "http://b.example.net/de/8/9", "http://y.org/es/", "http://y.org/en/",
    "http://casino.org/", "http://mycasinos.org/", "http://free-loan.org/", "http://free.org/free", "a://b://c.com/en/", "http://notcom/en/", "http://host#frag/en/", "http://h.org?x=/es/", "http://xn--é.org/POKER_bet", "http://h.org/" + "a" * 200_000 + "/porn",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    words = re.split("[^a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or ""))
    bad = any(t in words for t in TERMS.strict) or sum(t in words for t in TERMS.soft) >= TERMS.soft_least
    return host, path, best and best.name, best.verdict if best else "block" if bad else "allow"


def test_verdicts_equal_brute_force(spark):
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "x", 1), (None, URLS[10], "x", 1)]
    got = judge_urls(spark.createDataFrame(rows, "page_id int, url string, host string, _hits int")).collect()
    assert len(got) == len(rows)
    assert sorted((r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((u or "", *(x or "" for x in brute(u))) for _, u, *_ in rows)


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0
