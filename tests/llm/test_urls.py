import re

import numpy as np

from gridloom.llm.urls import DAMPING, RULES, judge, op4, propagate


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_ranks_match_a_matrix(spark):
    rng = np.random.default_rng(4)
    n = 12
    links = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(links, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "h0", 1.0), ("trust", "h1", 1.0), ("distrust", "h5", 1.0)], "kind string, host string, mass double")
    got = {(r.kind, r.host): r["rank"] for r in propagate(edges, seeds).collect()}
    for kind, m, s in (("trust", links, [0, 1]), ("distrust", links.T, [5])):
        seed = np.zeros(n)
        seed[s] = 1 / len(s)
        p = np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros((n, n)), where=m.sum(axis=1, keepdims=True) > 0)
        rank = seed
        for _ in range(20):
            moved = DAMPING * rank @ p
            rank = moved + seed * (1 - moved.sum())
        assert all(abs(got.get((kind, f"h{i}"), 0) - rank[i]) < 1e-5 for i in range(n))


def test_distrust_flows_against_links(spark):
    pages = [(1, "http://Spam.NET/x", None), (2, "http://farm.io/a?b://c", '<a href="http://spam.net/buy">x</a>'), (3, "http://ok.io", "<a href=/x>"),
             (4, None, "x"), (5, "no scheme", ""), (None, "http://good.org/fr/1", '<a href="//liked.io/1">'), (7, "http://liked.io#f", None)]
    rows = {r.id: r for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [rows[i].verdict for i in (1, 2, 3, 4, 5, None, 7)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert (rows[2].host, rows[2].path, rows[4].host, rows[7].host) == ("farm.io", "/a", "", "liked.io")
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_rules(spark):
    for r in op4(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url"), "page_id").collect():
        host, path = parse(r.url)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_distrust_reaches_far_hosts(spark):
    pages = [(0, "http://h0.net/", None)] + [(i, f"http://h{i}.io/", f'<a href="http://h{i - 1}.{"io" if i > 1 else "net"}/">x</a>') for i in range(1, 26)]
    assert {r.verdict for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"block"}
