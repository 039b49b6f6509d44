"""URL rules and models against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from grainguard.llm import urls
from grainguard.llm.queries import QUERIES, URL_RULES


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [
        (len(rule), rule, kind)
        for kind, rule in URL_RULES
        for name, rest in [(rule[: rule.index("/")], rule[rule.index("/") :])]
        if (host == name or host.endswith("." + name)) and path.startswith(rest)
    ]
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    """(url -> verdict) by counting grams in dictionaries."""
    known = Counter(u for u in rows if u is not None)
    side = {u: plain_rule(u)[1] for u in known}
    n = urls.ORDER

    def grams(u):
        bare = re.sub(r"(?s)^.*?://", "", u, count=1)
        p = urls.BEFORE * (n - 1) + bare + urls.AFTER
        return [p[i : i + n] for i in range(len(bare) + 1)]

    own = {s: Counter() for s in urls.SIDES}
    before = {s: Counter() for s in urls.SIDES}
    for u, weight in known.items():
        if side[u]:
            for g in grams(u):
                for k in range(1, n + 1):
                    own[side[u]][g[n - k :]] += weight
                    before[side[u]][(k, g[n - k : n - 1])] += weight

    def log_p(s, g, less):
        p = 1 / urls.ALPHABET
        for k in range(1, n + 1):
            p = (max(own[s][g[n - k :]] - less, 0) + urls.PRIOR * p) / (max(before[s][(k, g[n - k : n - 1])] - less, 0) + urls.PRIOR)
        return math.log(p)

    def score(u):
        gs = grams(u)
        return round(sum(log_p("allow", g, side[u] == "allow") - log_p("block", g, side[u] == "block") for g in gs) / len(gs), 9)

    scores = {u: score(u) for u in known}
    steps = sorted({math.floor(scores[u] * urls.BINS) for u in known if side[u]})
    sums = {s: sum(w for u, w in known.items() if side[u] == s) for s in urls.SIDES}
    limit = 0.0
    if all(sums.values()):
        best = -1
        for step in steps:
            under = {s: sum(w for u, w in known.items() if side[u] == s and math.floor(scores[u] * urls.BINS) < step) for s in urls.SIDES}
            share = (1 - under["allow"] / sums["allow"] + under["block"] / sums["block"]) / 2
            if share > best:
                best, limit = share, step / urls.BINS
    return {u: side[u] or ("allow" if u and scores[u] >= limit else "block") for u in known}


def made(seed):
    r = random.Random(seed)
    hosts = ["a.example.net", "EXAMPLE.net", "x.example.com", "good.example.org", "casino.example.com", "org", "notnet", "un.net"]
    tails = ["", "/", "/en/", "/en", "/fr/3", "/de/77?x=/en/", "/de", "#top", "/es/ü", "?q=1"]
    rows = [f"{r.choice(['http', 'https', 'HTTP'])}://{r.choice(hosts)}{r.choice(tails)}{r.choice(['', r.randint(1, 99)])}" for _ in range(300)]
    return rows + [None, "", "no scheme", "://", "a://b://c.net/", "http://net/\n/x", "http:///en/"] + [rows[0]] * 150


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionaries(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(rows)], "page_id long, url string, host string, weight int")
    out = urls.judge_urls(df, URL_RULES).collect()
    wanted = brute(rows)
    assert len(out) == len(rows)
    for row in out:
        assert (row.host, row.path) == plain_parts(row.url)
        assert row.rule == plain_rule(row.url)[0]
        assert row.verdict == (wanted[row.url] if row.url is not None else "block"), row
        assert row.weight == 1


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.test/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge_urls(df, URL_RULES).collect()} <= {"allow", "block"}
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    wanted = brute(list(pages.values()))
    rows = QUERIES["op7_url_model_ratio"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.verdict == wanted[pages[r.page_id]] for r in rows)


def test_a_url_of_a_million_letters(spark):
    import time

    long = "data://x.org/fr/" + "ab é😀c" * 170_000
    rows = [(1, long), (2, long + "z"), (3, "http://a.net/b"), (4, "http://b.org/fr/c"), (5, "http://c.com/" + "q" * 2500), (6, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    start = time.monotonic()
    got = {r.page_id: (r.host, r.rule) for r in urls.judge_urls(df, URL_RULES).select("page_id", "host", "rule", "verdict").collect()}
    assert time.monotonic() - start < 60 and len(got) == 6
    assert got[1] == ("x.org", "org/fr/") and got[5] == ("c.com", None)


def test_pieces_hold_every_gram_once(spark):
    text = "http://" + "".join(chr(97 + i % 23) for i in range(3 * urls.PIECE + 7))
    df = spark.createDataFrame([(0, text, "allow", 1), (1, "u://", "block", 2)], "id long, url string, verdict string, weight long")
    found = urls.grams(df).groupBy("id", "gram").count().collect()
    padded = urls.BEFORE * (urls.ORDER - 1) + text[7:] + urls.AFTER
    want = {}
    for i in range(len(padded) - urls.ORDER + 1):
        want[padded[i : i + urls.ORDER]] = want.get(padded[i : i + urls.ORDER], 0) + 1
    assert {r.gram: r["count"] for r in found if r.id == 0} == want
    assert [r["count"] for r in found if r.id == 1] == [1]
