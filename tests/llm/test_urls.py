"""URL verdicts against a plain version: parsing, the longest rule, all frequent combinations, matching."""

import re
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from prosemill.llm.queries import URL_RULES
from prosemill.llm.url_rules import LEAST_URLS, judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url):
    if url is None or "://" not in url:
        return "", "", "", ""
    rest = url.split("://", 1)[1]
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path, query, fragment


def listed(host, path):
    best = None
    for rule, says in URL_RULES:
        at, _, below = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return best


def tokens(url):
    host, path, query, fragment = (re.sub("[0-9]+", "#", x) for x in parse(url))
    labels = host.split(".")
    named = [("tld", labels[-1]), *(("host", x) for x in labels[:-1]), *(("dir", x) for x in path.split("/"))]
    named += [("arg", x.split("=")[0]) for x in re.split("[&;]", query)] + [("fragment", fragment)]
    return frozenset(f"{k}={v}" for k, v in named if v)


def plain(urls, confidence=0.6, labels=None):
    seen = labels if labels is not None else [(u, (listed(*parse(u)[:2]) or (None, "none"))[1]) for u in urls]
    bags = [(tokens(u), says) for u, says in seen if tokens(u)]
    where = defaultdict(list)
    for k, (bag, _) in enumerate(bags):
        for t in bag:
            where[t].append(k)
    stands = {}
    for t in sorted(where):
        if len(where[t]) >= LEAST_URLS:
            stands.setdefault(tuple(where[t]), t)
    frequent = set(stands.values())
    count, with_label = Counter(), Counter()
    for bag, says in bags:
        own = sorted(bag & frequent)
        for n in range(1, len(own) + 1):
            for c in combinations(own, n):
                count[c] += 1
                with_label[c, says] += 1
    rules = [(k / count[c], k / len(bags), len(c), " ".join(c), says, set(c)) for (c, says), k in with_label.items() if k >= LEAST_URLS and k / count[c] >= confidence and says != "none"]
    out = []
    for url in urls:
        host, path = parse(url)[:2]
        rule = listed(host, path)
        fits = [r[:5] for r in rules if rule is None and r[5] <= tokens(url)]
        out.append((host, path, rule and rule[0], rule[1] if rule else max(fits)[4] if fits else "allow", max(fits)[3] if fits else None))
    return out


def urls():
    out = [f"http{'s' * (k % 2)}://{s}.example.{t}/{d}/{k}{e}" for k in range(90) for s, t, d, e in [(("www", "m.casino-win", "blog.the")[k % 3], ("com", "net", "org")[k % 7 % 3], ("en", "de", "es", "fr")[k % 4], ("", "?a=1&b", "#top", ".html")[k % 5 % 4])]]
    out += [f"https://deep{k}.example.com/en/{'/'.join(f'part{j}' for j in 'abcdefghijklmnopqrstuvwxyz')}?x{k}=1" for k in range(12)]
    out += [f"https://spam{k}.pills.example.com/{'en' if k % 4 else 'xx'}/{k}" for k in range(20)]
    out += [f"https://e{k}.org/fr/same/segments/same/{'q' * k}" for k in range(8)]
    return out


ODD = [None, "", "no scheme", "http://", "http:///en/", "HTTP://EXAMPLE.Com/en/7", "x://É.Com/en/é?q#f", "://com/en/", "http://com/en/7", "http://acom/en/", "a://b://com/en/", "http://net?de/", "http://net#/de/", "http://example.net/de/8\n9?x", "http://example.net/de/", "http://h/" + "seg/" * 20_000, "http://h.com" + "/s1" * 400 + "?" + "k=v&" * 5000]


def test_equals_plain_version(spark):
    every = urls() + ODD
    rows = [(k if k % 10 else None, u) for k, u in enumerate(every)] + [(3, every[3])] * 30
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "tokens", "rule", "label", "key", "html")})
    got = sorted((tuple(r) for r in judge_urls(pages, URL_RULES).collect()), key=str)
    want = [(k, *x) for (k, _), x in zip(rows, plain([u for _, u in rows]), strict=True)]
    assert got == sorted(want, key=str)
    assert {r[5] for r in got} > {None} and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_given_labels(spark):
    labels = [(f"http://shop{k}.example.org/offer/deep/deeper/casino/{k}?aff={k}", "block") for k in range(9)] + [(f"http://n{k}.example.org/news/deep/{k}", "allow") for k in range(9)] + [("http://x/y", None), (None, "block")]
    ask = ["http://a.b.fr/1/2/3/casino", "http://a.b.fr/?aff", "http://n.org/news", "http://c.fr/deep", "http://example.org/"]
    pages = spark.createDataFrame(list(enumerate(ask)), "page_id long, url string")
    got = [r.verdict for r in judge_urls(pages, URL_RULES, spark.createDataFrame(labels, "url string, label string")).orderBy("page_id").collect()]
    want = [x[3] for x in plain(ask, labels=[x for x in labels if x[1]])]
    assert got == want == ["block", "allow", "allow", "allow", "allow"] or got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/1")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(one, URL_RULES, none.selectExpr("url", "url AS label")).collect()] == [(1, "a.com", "/en/1", "com/en/", "block", None)]
