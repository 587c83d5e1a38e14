import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from medwarden.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return best or (None, None)


def model(urls):
    grams, kinds = Counter(), defaultdict(set)
    for u in urls:
        t = "\x02" * 4 + u + "\x03"
        for i in range(4, len(t)):
            for k in range(5):
                grams[t[i - k : i], t[i]] += 1
                kinds[t[i - k : i]].add(t[i])
    totals = Counter()
    for (c, _), n in grams.items():
        totals[c] += n

    def chance(c, x):
        p = 1 / 256
        for k in range(5):
            ctx = c[4 - k :]
            if totals[ctx]:
                d = len(kinds[ctx])
                p = (grams[ctx, x] + d * p) / (totals[ctx] + d)
        return p

    return chance


def test_matches_brute_force(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in U.url_filter(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    train = defaultdict(list)
    for _, u in pages:
        rule = ruled(*parts(u))
        if rule[1] and zlib.crc32(u.encode()) % 5:
            train[rule[1]].append(u)
    a, r = model(train["allow"]), model(train["block"])
    cut = {"allow": math.inf, "block": -math.inf}
    for i, u in pages:
        host, path = parts(u)
        rule, verdict = ruled(host, path)
        t = "\x02" * 4 + u + "\x03"
        logs = [math.log(a(t[k - 4 : k], t[k]) / r(t[k - 4 : k], t[k])) for k in range(4, len(t))]
        g = got[i]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert abs(g.score - sum(logs) / len(logs)) < 2e-6
        if rule:
            assert g.verdict == verdict
        elif g.verdict == "allow":
            cut["allow"] = min(cut["allow"], g.score)
        else:
            cut["block"] = max(cut["block"], g.score)
    assert cut["block"] < cut["allow"]


def test_odd_tables(spark):
    data = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/ES/x"), (5, "http://x.org"),
            (6, "http://x.org?a=/b"), (7, "x://b.example.org/es/?q"), (8, "http://c.com/de/" + "y" * 30000),
            (8, "http://c.com/fr/z"), (8, "http://c.com/fr/z"), (None, "a://notorg/"), (9, "u://org/#")]
    df = spark.createDataFrame(data, "page_id bigint, url string").selectExpr("*", "1 as host", "2 as window", "3 as score", "4 as n")
    got = defaultdict(list)
    for x in U.url_filter(df).collect():
        got[x.page_id].append(x)
    assert sum(map(len, got.values())) == len(data)
    assert [(got[i][0].host, got[i][0].path, got[i][0].rule, got[i][0].verdict) for i in (1, 2)] == [("", "", None, "allow")] * 2
    assert (got[4][0].host, got[4][0].path, got[4][0].rule) == ("a.example.org", "/ES/x", "org/")
    assert got[5][0].rule is None and got[6][0].rule is None and got[None][0].rule is None
    assert (got[7][0].rule, got[7][0].verdict) == ("example.org/es/", "block")
    assert got[9][0].rule == "org/" and len(got[8]) == 3
    assert U.url_filter(df.limit(0)).count() == 0
