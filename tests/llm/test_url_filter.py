import collections
import hashlib
import math
import re

from pyspark.sql import functions as F

from riskstream.llm import url_filter as U

URLS = ["http://www.Example.net/en/1", "https://example.net/EN/2?x=/en/", "http://a.b.org/fr/3#top", "http://shop.example.com/de/4",
        "http://shop.example.com/en/5", "http://org/fr/", "http://notexample.net/en/x", "http://x.net", "ftp://y.net?q", "no scheme.net/en/",
        None, "", "http://", "http://example.network/en/", "HTTP://EXAMPLE.NET/en", "http://é.org/fr/ü", "http://a.com/" + "long/" * 3000,
        "http://shop.example.com/en/5", "://z.org/fr/#", "http://a://b.net/en/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    best = (None, None)
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, v)
    return best


def brute(urls):
    def sym(u):
        u = "".join("0" if c in "0123456789" else c.lower() if "A" <= c <= "Z" else c for c in u)
        return "^^^" + re.sub(r"(?s)[^a-z0./\-]", "?", u) + "$"

    distinct = {u or "": rule(*parts(u))[1] for u in urls}
    counts = {c: collections.Counter() for c in "ar"}
    fits = {u: hashlib.md5(u.encode()).hexdigest()[0] < "8" for u in distinct}
    for u, v in distinct.items():
        if v and fits[u]:
            s = sym(u)
            for i in range(3, len(s)):
                for k in range(4):
                    counts[v[0] if v == "allow" else "r"][s[i - k:i], s[i]] += 1

    def p(c, ctx, x):
        lower = p(c, ctx[1:], x) if ctx else 1 / 32
        follow = [n for (h, _), n in counts[c].items() if h == ctx]
        return (counts[c][ctx, x] + len(follow) * lower) / (sum(follow) + len(follow)) if follow else lower

    memo = {}

    def ratio(g):
        if g not in memo:
            memo[g] = math.log(p("a", g[:3], g[3]) / p("r", g[:3], g[3]))
        return memo[g]

    score = {}
    for u, v in distinct.items():
        if not v or not fits[u]:
            s = sym(u)
            score[u] = sum(ratio(s[i - 3:i + 1]) for i in range(3, len(s))) / (len(s) - 3)
    a = [score[u] for u, v in distinct.items() if v == "allow" and not fits[u]]
    r = [score[u] for u, v in distinct.items() if v == "block" and not fits[u]]
    edges = sorted({math.floor(min(max(x, -8), 8) / 0.01) for x in a + r})
    cut = 0.0
    if a and r:
        cut = min((round(sum(math.floor(x / 0.01) < b for x in a) / len(a) + sum(math.floor(x / 0.01) >= b for x in r) / len(r), 12), b)
                  for b in edges)[1] * 0.01
    return [(*parts(u), rule(*parts(u))[0], rule(*parts(u))[1] or ("allow" if score[u or ""] >= cut else "block")) for u in urls]


def test_against_brute_force(spark):
    urls = URLS + [f"http://{h}/{lang}/{i}" for i in range(60) for h, lang in
                   [("a.example.net", "en"), ("b.example.net", "fr"), ("c.org", "fr"), ("d.example.com", "de"), (f"e{i % 7}.example.com", "en")]]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, HOST string") \
        .withColumn("label", F.lit("x")).withColumn("g", F.lit(2))
    out = U.filter_urls(df)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert [got[i] for i in range(len(urls))] == brute(urls)
    assert {"label", "g"} <= set(out.columns)


def test_empty_table_and_one_class(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/fr/1"), (2, "http://x.org/en/1"), (None, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.filter_urls(one).collect()}
    assert got[1] == "allow" and set(got) == {1, 2, None} and None not in got.values()
