"""Redirect equivalence and connected components against plain Python."""

import random

from versekit.llm import queries, urls
from versekit.llm.components import components


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    path = list(range(200))
    rng.shuffle(path)
    cases = [[], [(1, 1)], [(2, 1), (1, 2), (3, 3)], list(zip(path, path[1:])), [(0, i) for i in range(300)] + [(i, 1000 + i) for i in range(300)],
             [(rng.randrange(500), rng.randrange(500)) for _ in range(350)]]
    for pairs in cases:
        got = components(spark.createDataFrame([*pairs, (None, 5)], "u long, v long"))
        assert {r["node"]: r["root"] for r in got.collect()} == roots(pairs)


def page(links="", refresh=""):
    return ("<html><head>" + "".join(f'<link data-x=1 rel="canonical" href="{x}"/>' for x in links.split()) +
            (f'<META HTTP-EQUIV=refresh content="0; URL={refresh}">' if refresh else "") + "</head></html>")


def test_verdicts(spark):
    rows = [(1, "http://a.net/x", page("https://b.com/de/y")), (2, "https://B.com/de/y#frag", ""), (3, "http://c.net/z?q=1", page(refresh="/other")),
            (4, "http://c.net/other", page("//a.net/x")), (5, "http://d.net/free", page("http://e.com/fr/1")),
            (6, "http://d.net/alias", page("http://d.net/free http://f.com/de/2")), (7, None, None), (8, "nonsense", page("http://b.com/de/y")),
            (9, "http://d.net/alone", None), (9, "http://d.net/alone", None), (10, "http://x.org", ""), (11, "HTTP://Sub.Example.ORG/es/?a", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, queries.URL_RULES).collect())
    assert got[:7] == [
        (1, "a.net", "/x", None, "block"), (2, "b.com", "/de/y", "com/de/", "block"), (3, "c.net", "/z", None, "block"),
        (4, "c.net", "/other", None, "block"), (5, "d.net", "/free", None, "allow"), (6, "d.net", "/alias", None, "allow"), (7, "", "", None, "allow")]
    assert [g[4] for g in got[7:]] == ["allow"] * 4 + ["block"]
    assert got[7][1:3] == ("", "") and got[10][3] is None and got[11][1:4] == ("sub.example.org", "/es/", "example.org/es/")
    more = spark.createDataFrame([("http://d.net/alone", "http://b.com/de/y")], "src string, dst string")
    out = urls.judge_urls(df, queries.URL_RULES, redirects=more)
    assert {r["verdict"] for r in out.filter("page_id = 9").collect()} == {"block"} and out.count() == len(rows)
    assert urls.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
