import random
from urllib.parse import urlsplit

import pytest

from skeinwork.llm import urlfilter as U


def forms(url, most=5, deep=4):
    """The expressions of a plain URL, by brute force."""
    u = urlsplit(url)
    host, path, query = u.hostname, u.path or "/", "?" + u.query if u.query else ""
    labels = host.split(".")
    hosts = {host} | {".".join(labels[-n:]) for n in range(2, most + 1) if n < len(labels) and not host.replace(".", "").isdigit()}
    parts = path[1:].split("/")
    paths = {path + query, path} | {"/" + "".join(p + "/" for p in parts[:k]) for k in range(min(deep, len(parts)))}
    return {h + p for h in hosts for p in paths}


@pytest.mark.parametrize("url", ["http://a.b.c.d.e.f.g/1.html?q=1", "http://a.b/x/y/z/w/v.html", "https://10.0.0.1/a/b?c", "http://x.org", "http://x.org?q", "http://a.example.com/x/y/"])
def test_expressions(spark, url):
    got = spark.createDataFrame([(url,)], "url string").select(U.expressions(U.F.col("url"), 5, 4).alias("e")).first().e
    assert set(got) == forms(url) and len(got) == len(set(got))


def test_precedence_and_odd_rows(spark):
    rules = U.rule_frame(spark, [("e.com/", "block", "a"), ("e.com/", "block", "b"), ("w.e.com/", "allow", "c"), ("w.e.com/x/", "Block", "d"), ("e.com/x/y/z/", "allow", "long"), (None, "block", "n"), ("", "block", "n"), ("o.com/", "drop", "n"), ("t.com/", "allow", "t"), ("t.com/", "block", "t"), ("e.com/q?a=1", "allow", "q"), ("sp.com/a b/", "block", "s")])
    cases = [
        ("http://e.com/", "block", "e.com/"), ("HTTPS://u:p@W.E.COM.:8080/#f", "allow", "w.e.com/"), ("http://w.e.com/x/y/z/1", "block", "w.e.com/x/"), ("http://v.e.com/x/y/z/1", "allow", "e.com/x/y/z/"), ("http://xe.com/", "pass", None), ("http://e.com/q?a=1", "allow", "e.com/q?a=1"), ("http://e.com/q?a=2", "block", "e.com/"),
        ("http://o.com/", "pass", None), ("//t.com//", "allow", "t.com/"), ("http://sp.com/a%20b//c", "block", "sp.com/a b/"), ("http://sp.com/%zz", "pass", None), ("e.com", "pass", None), ("", "pass", None), (None, "pass", None), ("http:///x", "pass", None), ("http://" + "a." * 5000 + "e.com/" + "b/" * 5000, "block", "e.com/"), ("http://e.com/", "block", "e.com/"),
    ]
    pages = spark.createDataFrame([(k, c[0], "x", "y") for k, c in enumerate(cases)] + [(None, "http://e.com/", "", "")], "page_id bigint, url string, rule string, digest string")
    got = {r.page_id: (r.verdict, r.rule) for r in U.judge(pages, rules).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)} | {None: ("block", "e.com/")}
    assert {r.verdict for r in U.judge(pages, rules.limit(0)).collect()} == {"pass"}
    assert U.judge(pages.limit(0), rules).collect() == []
    assert {r.category for r in U.judge(pages, rules).where("rule = 'e.com/'").collect()} == {"a"}


def test_rules_of_any_depth_against_brute_force(spark):
    """Hundreds of rules, some with many labels and folders, against the expressions of each URL."""
    rng = random.Random(5)
    host = lambda n: ".".join(rng.choice("abc") for _ in range(n)) + ".com"
    path = lambda n: "/" + "".join(rng.choice("xy") + "/" for _ in range(n))
    urls = [f"http://{host(rng.randint(1, 9))}{path(rng.randint(0, 9))}{rng.choice(['', 'p.html', 'p.html?q=1'])}" for _ in range(400)]
    rules = {(host(rng.randint(1, 4)) + path(rng.randint(0, 3)), rng.choice(["allow", "block"]), "c") for _ in range(300)}
    for u in rng.sample(urls, 60):  # rules that are parts of URLs, some whole
        rules.add((rng.choice(sorted(forms(u, 99, 99))), rng.choice(["allow", "block"]), "c"))
    rank = lambda r: (-r[0].split("/")[0].count("."), -len(r[0].split("/", 1)[1]), r[1], r[0])
    want = {}
    for k, u in enumerate(urls):
        e = forms(u, 99, 99)
        best = min((r for r in rules if r[0] in e), key=rank, default=None)
        want[k] = (best[1], best[0]) if best else ("pass", None)
    got = U.judge(spark.createDataFrame(list(enumerate(urls)) + [(len(urls), urls[0])], "page_id bigint, url string"), U.rule_frame(spark, sorted(rules)))
    assert {r.page_id: (r.verdict, r.rule) for r in got.collect()} == want | {len(urls): want[0]}
    assert len({x for x in want.values() if x[1]}) > 60


def test_query(spark, medium, against_sql):
    against_sql(U.op7_url_filter(spark, medium), U.SQL, medium)
