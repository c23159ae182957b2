from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

from stripmill.llm import urls

SCHEMA = "page_id long, url string, host int, verdict string"


def corpus():
    rng = random.Random(2)
    rows = []
    for k in range(400):
        host = rng.choice(["", "www.", "blog."]) + rng.choice(["aa", "bb", "spam"]) + ".example." + rng.choice(["org", "com", "net"])
        rows.append((k, f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(300)}{rng.choice(['', '?page=2&ref=x', '#top', '/', '.html'])}", 1, "x"))
    return rows


ODD = [(900, None), (901, "no scheme/at all"), (902, "HTTP://WWW.Example.ORG"), (903, "http://example.org/es/"), (904, "x://org"), (905, "x://notorg/fr/"), (906, "x://a.com/de/1?q=://b.org/"), (907, "http://É.ORG/en?x"), (907, "http://É.ORG/en?x"), (None, "a://b.com?x=/fr/"), (908, ""), (909, "http://a\nb.com/fr/\n?")]


def parts(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if c in urls.UPPER else c for c in m[2]), m[3]


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def tokens(url):
    if "://" not in (url or ""):
        return frozenset()
    host, path = parts(url)
    scheme = url.split("://")[0].lower()
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    names = [x.split("=")[0] for x in query[1].split("&")] if query else []
    found = ["s:" + scheme, *("h:" + x for x in host.split(".")), *("p:" + re.sub(r"(?<=\d)\d", "#", x) for x in path.split("/")), *("q:" + x for x in names)]
    return frozenset(x for x in found if len(x) > 2)


def slow(rows):
    """Verdicts by counting all combinations."""
    labels = [(tokens(u), rule_of(*parts(u))[1]) for _, u, *_ in rows if rule_of(*parts(u))[0]]
    least, of, by = urls.SUPPORT * len(labels), Counter(), Counter()
    for t, v in labels:
        for n in range(1, len(t) + 1):
            for c in combinations(sorted(t), n):
                of[c] += 1
                by[c, v] += 1
    usual = "block" if sum(v == "block" for _, v in labels) * 2 > len(labels) else "allow"
    rules = {(c, v): (n / of[c], n) for (c, v), n in by.items() if n >= least and n / of[c] >= urls.CONFIDENCE}
    kept = [(conf, n, -len(c), v, frozenset(c)) for (c, v), (conf, n) in rules.items() if not any(rules.get((c[:k] + c[k + 1 :], v), (0, 0))[0] >= conf for k in range(len(c)) if len(c) > 1)]
    out = []
    for d, u, *_ in rows:
        host, path = parts(u)
        rule, verdict = rule_of(host, path)
        if not rule:
            verdict = max([(x[:3], x[3]) for x in kept if x[4] <= tokens(u)], default=(0, usual))[1]
        out.append((d, host, path, rule, verdict))
    return out


def test_against_brute_force(spark):
    rows = corpus() + [(d, u, 1, "x") for d, u in ODD]
    got = [tuple(r) for r in urls.judged(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow(rows)))


def test_no_labels_and_no_rows(spark):
    assert urls.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = urls.judged(spark.createDataFrame([(1, "http://a.net/x", 1, "x")], SCHEMA)).collect()
    assert tuple(one) == (1, "a.net", "/x", None, "allow")


def test_long_urls_of_few_labels(spark):
    """Thirty segments that stand together, in urls of both verdicts, have 2 ** 30 frequent combinations."""
    long = "/".join(f"seg{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    rows = [(k, f"http://a{k}.com/{['fr', 'de'][k % 3 == 0]}/{long}/{k}", 1, "x") for k in range(200)]
    rows += [(1000, f"http://b.net/{long}", 1, "x"), (1001, "http://b.net/de/x", 1, "x"), (1002, "http://b.net/other", 1, "x")]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: ["allow", "block"][k % 3 == 0] for k in range(200)} | {1000: "allow", 1001: "block", 1002: "allow"}
