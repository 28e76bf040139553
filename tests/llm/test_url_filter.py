import random

from tidemark.llm.graph import connected_components
from tidemark.llm.url_filter import RULES, judge

SCHEMA = "page_id long, url string, html string"


def verdicts(frame):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in frame.collect()}


def test_rules_fit_hosts_subdomains_and_path_starts(spark):
    pages = spark.createDataFrame(
        [(1, "http://Example.ORG/es/1?q#f", ""), (2, "https://a.example.org/en/17", None), (3, "http://notexample.org/es/", ""), (4, "http://x.com/fr/1", ""), (5, "http://x.com/de", ""), (6, "http://x.com/de/", ""), (7, "http://x.org", ""),
         (8, None, "x"), (9, "no scheme.org/", ""), (10, "http://q.net/?u=http://x.com/de/", "")], SCHEMA)
    assert verdicts(judge(pages, RULES)) == {
        1: ("example.org", "/es/1", "example.org/es/", "block"), 2: ("a.example.org", "/en/17", "example.org/en/1", "block"), 3: ("notexample.org", "/es/", "org/", "allow"), 4: ("x.com", "/fr/1", "com/fr/", "allow"),
        5: ("x.com", "/de", None, "allow"), 6: ("x.com", "/de/", "com/de/", "block"), 7: ("x.org", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("q.net", "/", None, "allow"),
    }


def test_many_rules_give_the_same_as_few(spark):
    rng = random.Random(3)
    hosts = ["a.com", "b.a.com", "com", "x.net", "net", "y.x.net"]
    rules = [(rng.choice(hosts), rng.choice(["/", "/p", "/p/q", "/z"]), rng.choice(["allow", "block"])) for _ in range(14)]
    pages = spark.createDataFrame([(i, f"http://{rng.choice(hosts + ['w.y.x.net', 'other.org'])}{rng.choice(['/', '/p', '/p/q/r', '/zz', ''])}", "") for i in range(200)], SCHEMA)
    from tidemark.llm.url_filter import apply_rules, with_parts

    few = apply_rules(with_parts(pages), rules).select("page_id", "rule", "rule_verdict")
    many = apply_rules(with_parts(pages), rules, inline=0).select("page_id", "rule", "rule_verdict")
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_blocks_reach_aliases_and_allow_has_precedence(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    pages = spark.createDataFrame(
        [(1, "http://bad.com/de/1", ""), (2, "http://alias.net/a", link.format("http://bad.com/de/1")), (3, "http://alias.net/b", '<meta http-equiv="Refresh" content="0;url=/a">'), (4, "http://free.net/c", link.format("http://other.net/")),
         (5, "http://good.org/x", link.format("http://both.net/m")), (6, "http://both.net/m", ""), (7, "http://also.net/n", link.format("http://both.net/m") + link.format("http://bad2.com/de/2")), (8, "http://alias.net/a#part", ""), (9, "http://rel.net/d/e", "<LINK href=f rel=canonical>"), (10, "http://rel.net/d/f", link.format("http://q.com/de/"))], SCHEMA)
    got = {k: v[3] for k, v in verdicts(judge(pages, RULES)).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block"}


def test_given_edges_and_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://m.net/1", None), (1, "http://m.net/1", None), (None, "http://m.net/2", ""), (3, "http://" + "a." * 3000 + "com/de/", "x" * 200_000)], SCHEMA)
    edges = spark.createDataFrame([("http://m.net/1", "http://evil.com/de/x"), (None, "http://m.net/2"), ("http://m.net/2", "http://m.net/2")], "u string, v string")
    got = [(r["page_id"], r["verdict"]) for r in judge(pages.selectExpr("*", "'x' as host", "'y' as rule"), RULES, edges).collect()]
    assert sorted(got, key=str) == sorted([(1, "block"), (1, "block"), (None, "allow"), (3, "block")], key=str)
    assert judge(spark.createDataFrame([], SCHEMA), RULES).collect() == []


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_ampersands_in_links(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/?p=1&amp;q=2">'), (2, "http://c.net/y", '<link rel="canonical" href="http://b.com/de/?p=1&#38;q=2">'), (3, "http://b.com/de/?p=1&q=2", "")], SCHEMA)
    rows = judge(pages, RULES).collect()
    assert {r["verdict"] for r in rows} == {"block"} and len({r["component"] for r in rows}) == 1
