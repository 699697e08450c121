"""URL filter against plain Python."""

import re

from simsift.llm import urlfilter as U
from simsift.llm.queries import RULES

SCHEMA = "page_id long, url string, host string"
URLS = ["https://a.example.net/en/1", "http://EXAMPLE.net/de/1?x=/en/", "https://example.com/de/x", "https://m.example.com/deutsch",
        "http://b.example.org/fr/9#top", "http://org/fr/", "http://xorg/fr/", "https://notexample.net/en/", "https://x.net",
        "https://x.net?/", None, "", "no scheme/net/", "a://b://c.net/x", "http://xxx.example.com/", "http://y.com/xxxl",
        "http://y.com/adult/SEX", "http://y.com/adult/adult", "http://y.com/éadulté-bet", "ftp://y.com\n/xxx", "http://y.com/poker?casino"]


def judge(url):
    url = url or ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1], m[2]) if m else ("", "")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in RULES:
        h, _, p = rule.partition("/")
        if (low == h or low.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    terms = re.split(r"[^a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url))
    strict, soft = [t for t in terms if t in U.STRICT], [t for t in terms if t in U.SOFT]
    own = "block" if strict or len(set(soft)) >= U.MIN_SOFT else "allow"
    score = sum((U.STRICT | U.SOFT)[t] for t in set(strict + soft))
    return low, path, best, RULES[best] if best else own, len(strict), len(soft), len(set(soft)), round(score, 6)


def test_equals_plain(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], ""), (0, URLS[0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = spark.createDataFrame(sorted(RULES.items()), "rule string, verdict string")
    out = U.judge_urls(df, rules).collect()
    assert len(out) == len(rows)
    for r in out:
        want = judge(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule, r.verdict, r.n_strict, r.n_soft, r.n_distinct, round(r.score, 6)) == want, r
    assert U.judge_urls(df.limit(0), rules).count() == 0
    free = U.judge_urls(df, rules.limit(0)).collect()
    assert len(free) == len(rows) and all(r.rule is None for r in free)


def test_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rules = spark.createDataFrame(sorted(RULES.items()), "rule string, verdict string")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in U.judge_urls(pages, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id])[:4]
