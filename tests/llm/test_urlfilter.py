import random

from hyperdelta.llm import urlfilter as U


def plain(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: r.rank, default=None)


def test_split():
    assert U.split("HTTP://Ab.É.net:80/x/y?q#f") == ("ab.É.net:80", "/x/y")
    assert U.split("a://b?x") == ("b", "") and U.split("a://b#/x") == ("b", "") and U.split("x://") == ("", "")
    assert U.split(None) == U.split("") == U.split("net/") == ("", "")
    assert U.split("a://b/c://d") == ("b", "/c://d")


def test_sweep_against_every_rule():
    rng = random.Random(8)
    labels, paths = ["a", "b", "net", "ne", ""], ["/", "/a", "/a/b", ""]
    name = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    for _ in range(300):
        rules = list({U.Rule(name(rng.randrange(1, 4)), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(rng.randrange(12))})
        urls = [(name(rng.randrange(1, 5)), rng.choice(["", "/", "/a", "/a/b/c", "/b"])) for _ in range(30)]
        assert U.sweep(urls, U.sorted_rules(rules)) == [plain(h, p, rules) for h, p in urls]


def test_edges_and_blocks(spark, monkeypatch):
    urls = [(1, "https://x.example.net/en/a"), (2, "https://example.net/de"), (3, None), (4, ""), (None, "http://org/fr/"), (6, "http://notnet/"), (6, "http://notnet/"), (7, "http://net"), (8, "http://a.net/" + "p" * 100_000)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    want = sorted((str(i), *U.split(u), r.text if (r := plain(*U.split(u), U.RULES)) else None, r.verdict if r else "allow") for i, u in urls)
    got = lambda rules: sorted((str(r[0]), *tuple(r)[1:]) for r in U.judge(df, rules).collect())
    assert got(U.RULES) == want and {w[3] for w in want} == {"net/", "example.net/en/", "org/fr/", None}
    monkeypatch.setattr(U, "BLOCK", 2)
    assert got(U.RULES) == want
    assert got(spark.createDataFrame([(r.host, r.path, r.verdict) for r in U.RULES], "host string, path string, verdict string")) == want
    assert U.judge(df.limit(0)).count() == 0 and all(v[4] == "allow" for v in got(()))


def test_rules_with_nulls(spark):
    df = spark.createDataFrame([(1, "a://x.net/p"), (2, "a://y.org/q")], "page_id long, url string")
    rules = [(None, "/p", "block"), ("net", None, "block"), ("org", "/q", None), (None, None, None), ("y.org", "/", "allow"), ("y.org", "/", "block")]
    rows = U.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [("net", "block"), ("y.org/", "block")]


def test_many_rules_and_many_paths_of_a_host():
    """Work does not grow with the rules for each url."""
    import time

    rules = [U.Rule("big.net", f"/{i}/", "block") for i in range(100_000)] + [U.Rule(f"h{i}.org", "/", "allow") for i in range(100_000)]
    hosts = U.sorted_rules(rules)
    urls = [(f"a.h{i}.org", "/x") for i in range(1000)] + [("w.big.net", f"/{i}/y") for i in range(1000)] + [("big.netz", "/1/")]
    began = time.perf_counter()
    got = U.sweep(urls, hosts)
    assert time.perf_counter() - began < 1
    assert [r.text if r else None for r in got] == [f"h{i}.org/" for i in range(1000)] + [f"big.net/{i}/" for i in range(1000)] + [None]
