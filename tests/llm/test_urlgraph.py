import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetlens.llm import urlgraph

SCHEMA = "page_id long, url string, html string"


def link(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


ROWS = [
    (1, "HTTPS://WWW.Example.COM/en/12?x=1#y", link("http://bad.org/x", "/local", "//good.net/")),
    (2, "http://example.com/en/77", link("http://good.net/a")),
    (3, "http://notexample.com/en/7", None), (4, "http://a.example.net/de/81", link("HTTP://mid.io/")), (5, "https://good.net/de/9", link("http://friend.io/p", "http://friend.io/q")),
    (6, "https://bad.org/es/1", link("http://mid.io")), (7, "ftp://friend.io", link("http://second.io/")), (8, "http://farm.io/", link("http://bad.org/")),
    (9, None, link("http://bad.org/")), (10, "no scheme/en/", ""), (11, "", None), (12, "http://far.io/?a=://b", ""), (13, "x://É.com/en/é", ""), (5, "https://good.net/de/9", link("http://friend.io/p", "http://friend.io/q")),
    (None, "http://com/en/", "" ), (14, "http://long.io/" + "x" * 200_000, ""), (15, "http://second.io", ""), (16, "http://mid.io#f", ""),
]


def brute(rows, rules, threshold, rounds=20, d=0.85):
    parsed = []
    for pid, url, html in rows:
        m = re.match(r"(?s)[^\x00]*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        best = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        parsed.append((pid, host, path, best and best[1], best and best[2], html or ""))
    edges = {}
    for _, host, _, _, _, html in parsed:
        if host:
            for t in {re.split("[/?#]", u.split("://", 1)[1] if "://" in u else u[2:])[0].lower() for u in re.findall(r'href="([^"]*)"', html) if "://" in u or u.startswith("//")}:
                if t and t != host:
                    edges[host, t] = edges.get((host, t), 0) + 1
    hosts = sorted({p[1] for p in parsed if p[1]} | {h for e in edges for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    score = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        w = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in edges.items():
            w[(at[a], at[b]) if kind == "trust" else (at[b], at[a])] += n
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        mass = np.array([np.mean([p[4] == verdict for p in parsed if p[1] == h] or [0]) for h in hosts])
        mass = mass / max(mass.sum(), 1e-300)
        x = mass
        for _ in range(rounds):
            x = (1 - d) * mass + d * x @ w
        score[kind] = x / max(x.sum(), 1e-300)
    out = []
    for pid, host, path, rule, verdict, _ in parsed:
        i = at.get(host)
        both = 0 if i is None else score["trust"][i] + score["distrust"][i]
        share = score["distrust"][i] / both if both else 0.0
        out.append((pid, host, path, rule, verdict or ("block" if share >= threshold else "allow"), share))
    return out


def test_equals_brute_force(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("host", F.lit("clash")).repartition(3)
    got = urlgraph.judge(pages).collect()
    key = lambda r: tuple(map(str, r[:5]))
    want = sorted(brute(ROWS, urlgraph.RULES, 0.5), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], atol=1e-4)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[8] == "block" and verdict[7] == "allow" and verdict[15] == "allow"


def test_no_links_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/es/", ""), (2, "http://a.org/x", ""), (3, "http://b.org/x", "")], SCHEMA)
    assert {r.page_id: r.verdict for r in urlgraph.judge(pages).collect()} == {1: "block", 2: "block", 3: "allow"}
    assert urlgraph.judge(pages.filter("false")).count() == 0


def test_longest_rule_wins(spark):
    df = spark.createDataFrame([("a.example.com", "/en/70"), ("example.com", "/en/8"), ("xcom", "/en/"), ("x.example.net", "/de/8"), ("com", "/en")], "h string, p string")
    got = df.select("h", urlgraph.match_rule(F.col("h"), F.col("p"))["rule"].alias("r")).collect()
    assert [r.r for r in got] == ["example.com/en/7", "com/en/", None, "example.net/de/8", None]


def test_scores_solve_the_linear_system(spark):
    n, d = 30, 0.85  # a chain with a way back, longer than twenty links
    edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(5, 0, 3.0), (12, 3, 1.0)]
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    mass = np.zeros(n)
    mass[0] = 1
    want = np.linalg.solve(np.eye(n) - d * w.T, (1 - d) * mass)
    e = spark.createDataFrame([("distrust", f"h{a}", f"h{b}", x) for a, b, x in edges], "kind string, src string, dst string, weight double")
    s = spark.createDataFrame([("distrust", "h0", 2.0)], "kind string, host string, mass double")
    got = {r.host: r.score for r in urlgraph.propagate(e, s).collect()}
    assert len(got) == n and np.allclose([got[f"h{i}"] for i in range(n)], want, rtol=1e-5, atol=0)
    with pytest.raises(RuntimeError):
        urlgraph.propagate(e, s, rounds=10)


def test_mass_lost_at_hosts_without_links_does_not_decide(spark):
    rows = [(1, "http://t.net/de/1", link("http://x.io/")), (2, "http://t.net/other", ""), (3, "http://b.org/es/1", link("http://x.io/")), (4, "http://x.io/", "")]
    rules = (("allow", "net", "/de/"), ("block", "org", "/es/"))
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in urlgraph.judge(pages, rules).collect()}
    want = {r[0]: r for r in brute(rows, rules, 0.5, rounds=200)}
    assert got[2].verdict == want[2][4] == "allow" and got[2].distrust < 0.5
    assert np.allclose([got[i].distrust for i in got], [want[i][5] for i in got], atol=1e-4)
    # x.io is linked alike by both, and reversed distrust doesn't flow to what a blocked host links to.
    assert got[4].verdict == "allow" and got[3].verdict == "block"
