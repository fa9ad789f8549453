import json

import pytest
from hyperdelta.functions import pointers as P
from hyperdelta.model import as_json, delta, frame, ref
from hyperdelta.operators import filters, hyperview, replicate, timetravel, view
from hyperdelta.operators.filters import DeltaFilter
from hyperdelta.plans import schemadata
from hyperdelta.plans.schema import CircularSchema, HyperSchema, Registry, Rule, SchemaError, Versions, cycle, depth, dependents, topological, validate, would_create_cycle
from hyperdelta.queries import worked_example
from hyperdelta.sources.log import DeltaLog, Store, from_feed, to_feed
from pyspark.sql import functions as F


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_validation(spark):
    good = delta("a", 1, "x", "s", [])
    bad = [delta("", 1, "x", "s", []), delta("b", 0, "x", "s", []), delta("c", 1, "", "s", []), delta("d", 1, "x", "", []), delta("e", 1, "x", "s", [("r", 1), ("", 2)]), delta("f", 1, "x", "s", [("r", ref(""))])]
    log = DeltaLog(frame(spark, [good, *bad]))
    errors = {r["id"]: r["error"] for r in log.quarantine().collect()}
    assert ids(log.valid().deltas) == ["a"] and errors["e"] == "Invalid pointer at index 1: role must be a non-empty string" and "index 0" in errors["f"]
    empty_context = frame(spark, [delta("g", 1, "x", "s", [("r", ref("t", ""))])]).select(P.is_reference(F.col("pointers")[0]).alias("r"), P.is_domain_node(F.col("pointers")[0]).alias("d"))
    assert tuple(empty_context.first()) == (False, True)


def test_filters(spark):
    log = worked_example(spark)
    find = lambda **k: ids(filters.query(log, DeltaFilter(**k)))
    assert find(target_ids=["alice"]) == ["d1", "d3"]
    assert find(target_ids=["alice"], target_contexts=["author"]) == ["d3"]  # met by two pointers
    assert find(ids=["d5"]) == [] and find(ids=["d5"], include_negated=True) == ["d5"]
    assert find(start=1001, end=1003) == ["d2", "d3"]
    assert find(ids=[]) == find(authors=[]) == find(target_ids=[]) == []
    assert find(predicate="author = 'bob'") == ["d4", "d6"]
    assert ids(filters.query(log, DeltaFilter(ids=["d5"]), asof=3200)) == ["d5"]  # retracted later
    assert [r["id"] for r in filters.by_ids(log, ["d3", "zz", "d1"]).orderBy("ord").collect()] == ["d3", "d1"]
    assert [r["id"] for r in filters.scan(log, after=(2001, "d4")).collect()] == ["d4", "d5", "d6"]


def test_worked_example_views(spark):
    log = worked_example(spark)
    registry = Registry()
    registry.register(HyperSchema("entity", "Entity", {"name": Rule("string")}))
    registry.register(HyperSchema("post", "Post", {"author": Rule("entity"), "comment": Rule("entity")}))
    row = hyperview.nested(log, "post", registry, ["post"]).first().asDict(recursive=True)
    assert set(row["props"]) == {"title", "author", "comments"}
    opened = row["props"]["author"][0]["pointers"][1]["view"]["author"]
    assert opened["object_id"] == "alice" and set(opened["props"]) == {"name", "posts"}
    assert row["props"]["author"][0]["pointers"][0]["view"] is None
    assert hyperview.long_form(log, ["c2"]).count() == 0 and hyperview.long_form(log, ["c2"], asof=3200).count() == 1
    plain = view.resolve(hyperview.long_form(log, ["post"]), view.ViewSchema({"title": view.Property("title", P.primitive("title")), "by": view.Property("author", P.reference("author"))}))
    assert tuple(plain.first()) == ("post", "On logs", "alice")
    assert ids(hyperview.closure(log, "post", registry, ["post"])) == ["d1", "d2", "d3", "d4"]


def test_unknown_schema_is_refused_only_when_used(spark):
    registry = Registry()
    registry.register(HyperSchema("post", "Post", {"author": Rule("nowhere")}))
    with pytest.raises(SchemaError, match="Schema not found"):
        hyperview.nested(worked_example(spark), "post", registry)


def strategies(spark, *rows):
    deltas = [delta(f"r{i}", t, author, system, [("x", ref("o", "p")), ("v", value)]) for i, (t, author, system, value) in enumerate(rows)]
    return hyperview.long_form(DeltaLog(frame(spark, deltas)))


def one(long, strategy, value=None):
    return view.resolve_each(long, P.number("v") if value is None else value, strategy).first()["value"]


def test_strategies_and_ties(spark):
    long = strategies(spark, (5, "a", "s", 1), (9, "b", "s", 2), (9, "c", "t", 3), (5, "b", "s", 4))
    assert one(long, view.most_recent) == 2 and one(long, view.first_write) == 1
    assert one(long, view.all_values) == [1, 2, 3, 4]
    assert one(long, view.trusted_author(["z", "b", "a"])) == 2 and one(long, view.trusted_author(["z"])) == 2 and one(long, view.trusted_author([])) == 2
    assert one(long, view.trusted_system(["t"])) == 3
    assert one(long, view.average()) == 2.5 and one(long, view.minimum()) == 1 and one(long, view.maximum()) == 4
    votes = strategies(spark, (1, "a", "s", "active"), (2, "a", "s", "inactive"), (3, "b", "s", "inactive"), (4, "b", "s", "active"))
    assert one(votes, view.consensus, P.primitive("v")) == "active"  # equal counts: first seen
    assert one(votes, view.average()) is None


def test_one_exchange_for_many_properties(spark, sf):
    from hyperdelta import queries

    long = queries.bridge.events(spark, sf, retractions=False).references
    schema = view.ViewSchema({c: view.Property(c, P.number("value")) for c in ("click", "view", "error", "purchase")})
    plan = view.resolve(long, schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_time_travel(spark):
    rows = [delta("n", 1000, "a", "s", [("e", ref("o", "name")), ("name", "x")]), delta("g", 2000, "a", "s", [("e", ref("o", "age")), ("age", 3)]), delta("h", 3000, "a", "s", [("e", ref("o", "age")), ("age", 4)])]
    rows.append(delta("neg", 4000, "a", "s", [("negates", ref("g", "negated_by"))]))
    rows.append(delta("neg2", 5000, "a", "s", [("negates", ref("neg", "negated_by"))]))
    log = DeltaLog(frame(spark, rows))
    n = {t: timetravel.view_at(log, ["o"], t).count() for t in (500, 1000, 2000, 3000, 4000, 5000)}
    assert n == {500: 0, 1000: 1, 2000: 2, 3000: 3, 4000: 2, 5000: 3}
    times = spark.createDataFrame([("o", t) for t in n], "object_id string, timestamp long")
    assert {r["timestamp"]: r["n"] for r in timetravel.replay_counts(log, times).collect()} == n
    changed = timetravel.compare(log, ["o"], 1000, 3000).collect()
    assert {(r["property"], r["added"]) for r in changed} == {("name", 0), ("age", 2)}
    assert timetravel.origin(log, ["o"]).first()["id"] == "n"
    at = timetravel.stats_at(log, 4000).first()
    assert (at["total"], at["negated"], at["active"]) == (4, 1, 3)
    assert timetravel.snapshot(log, 4000).first()["negated_count"] == 1
    assert [r["previous"] for r in timetravel.property_changes(log, ["o"], "age", P.number("age")).orderBy("timestamp").collect()] == [None, 3.0]


def test_replay_takes_every_kth_time(spark):
    log = DeltaLog(frame(spark, [delta(f"d{i}", i + 1, "a", "s", [("e", ref("o", "p")), ("v", i)]) for i in range(25)]))
    got = sorted(r["timestamp"] for r in timetravel.replay_times(log, ["o"], most=10).collect())
    assert got == list(range(1, 26, 2))  # floor(25 / 10) = 2, so more than 10


def test_store_is_idempotent_and_ordered(spark, tmp_path):
    store = Store(spark, str(tmp_path / "log"))
    log = worked_example(spark)
    store.append(log.deltas)
    store.append(log.deltas)
    again = delta("d9", 90_000_000, "a", "s", [("n", 1)])
    store.append(frame(spark, [again, again]))
    rows = store.read().orderBy("seq").collect()
    assert [r["id"] for r in rows] == ["d1", "d2", "d3", "d4", "d5", "d6", "d9"] and [r["seq"] for r in rows] == list(range(7))
    assert ids(store.read(start=3000, end=3500)) == ["d5", "d6"]
    with pytest.raises(ValueError, match="author"):
        store.append(frame(spark, [delta("x", 1, "", "s", [])]))
    store.clear()
    assert store.read().count() == 0


def test_feed_keeps_kinds(spark):
    rows = [delta("a", 1, "x", "s", [("r", ref("t", "c")), ("r", ref("u")), ("s", "5"), ("n", 5), ("f", 0.25), ("b", True), ("q", 'a"\\\n}')])]
    back = from_feed(to_feed(frame(spark, rows))).first()
    assert as_json(back) == as_json(frame(spark, rows).first())
    assert json.loads(to_feed(frame(spark, rows)).first()["value"])["pointers"][2]["target"] == "5"


def test_merge_is_a_union(spark):
    log = worked_example(spark)
    a, b = DeltaLog(log.deltas.where("seq < 4")), DeltaLog(log.deltas.where("seq > 1"))
    want = sorted(map(str, log.deltas.collect()))
    for parts in ((a, b), (b, a), (a, b, a, b)):
        assert sorted(map(str, replicate.merge(*parts).deltas.collect())) == want
    assert ids(replicate.missing(a, b)) == ["d1", "d2"]
    assert ids(replicate.outgoing(log.deltas, "pull", "other")) == [] and ids(replicate.outgoing(log.deltas, "push", "blog")) == []


def test_schemas():
    a, b, c = HyperSchema("a", "A", {"x": Rule("b")}), HyperSchema("b", "B", {"y": Rule("c"), "n": Rule("integer")}), HyperSchema("c", "C")
    registry = Registry()
    for s in (a, b, c):
        registry.register(s, validate=True)
    assert [s.id for s in topological(registry)] == ["c", "b", "a"] and depth("a", registry) == 3 and dependents("c", registry) == ["b"]
    closing = HyperSchema("c", "C", {"z": Rule("a")})
    assert would_create_cycle(closing, registry) and not would_create_cycle(c, registry)
    with pytest.raises(CircularSchema) as e:
        registry.register(closing, validate=True)
    assert e.value.cycle == ["c", "a", "b", "c"] and registry["c"] is c
    twice = HyperSchema("t", "T", {"p": Rule("gone"), "q": Rule("gone")})
    assert cycle("t", {"t": twice}) is None
    assert validate(HyperSchema("", "", {"p": Rule("")}, "odd")).errors and not validate(HyperSchema("s", "S", {"p": Rule("s")})).valid
    versions = Versions()
    versions.register(a)
    assert not versions.outdated("a", a.hash()) and versions.outdated("a", "other") and not versions.outdated("unknown", "x")
    assert a.hash() == HyperSchema("a", "A", {"x": Rule("b")}).hash() != HyperSchema("a", "A").hash()


def test_schemas_in_the_log(spark):
    made = schemadata.terminal("s1", "One") + [schemadata.rule("s1", "author", "s2")]
    rows = [delta(f"k{i}", 10 + i, "system", "x", p) for i, p in enumerate(made)]
    log = DeltaLog(frame(spark, rows))
    found = schemadata.load(log)["s1"]
    assert found.name == "One" and found.rules == {"author": Rule("s2")} and found.selector == "by_target_context"
    catalog = schemadata.Catalog(log)
    gone = DeltaLog(frame(spark, [*rows, delta("u", 50, "system", "x", [("negates", ref("k3", "negated_by"))])]))
    assert not catalog.changed(log, "s1") and catalog.changed(gone, "s1") and catalog.refresh(gone) == ["s1"] and catalog.registry["s1"].rules == {}


def test_look_ups_read_only_what_the_index_names(spark, tmp_path):
    """By target, context, author and system, over several days and batches; the plan reads the key's bucket and the days it names."""
    store = Store(spark, str(tmp_path / "log"))
    day = 86_400_000
    rows = [delta(f"d{i}", day * (1 + i % 5) + i, f"a{i % 3}", f"s{i % 2}", [("x", ref(f"o{i % 7}", "p" if i % 2 else "q")), ("y", ref(f"o{i % 4}"))]) for i in range(60)]
    store.append(frame(spark, rows[:30]))
    store.append(frame(spark, rows[20:]))
    every = {r["id"]: r for r in store.log().deltas.collect()}
    assert len(every) == 60
    refs = lambda r: {(p["ref_id"], p["ref_context"]) for p in r["pointers"]}
    want = lambda test: {i for i, r in every.items() if test(r)}
    assert {*ids(store.find(target=["o5"]))} == want(lambda r: any(o == "o5" for o, _ in refs(r)))
    assert {*ids(store.find(target=["o1", "o6"], author=["a1"]))} == want(lambda r: r["author"] == "a1" and any(o in ("o1", "o6") for o, _ in refs(r)))
    assert {*ids(store.find(context=["q"], system=["s0"], start=2 * day, end=3 * day))} == want(lambda r: r["system"] == "s0" and any(c == "q" for _, c in refs(r)) and 2 * day <= r["timestamp"] <= 3 * day)
    assert ids(store.find(target=[])) == ids(store.find(target=["nothing"])) == [] and len(ids(store.find())) == 60
    (only,) = {r["day"] for r in store.entries("target", ["o5"]).where("timestamp < 2 * 86400000").collect()}
    plan = store.entries("target", ["o5"])._jdf.queryExecution().executedPlan().toString()
    assert only == 1 and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        store.entries("colour", ["red"])
    store.reindex()
    assert len(ids(store.find(author=["a2"]))) == 20
    store.clear()
    assert ids(store.find(target=["o5"])) == [] and ids(store.log().deltas) == []


def test_times_read_only_their_days(spark, tmp_path):
    store = Store(spark, str(tmp_path / "log"))
    day = 86_400_000
    store.append(frame(spark, [delta(f"d{i}", day * i + 5, "a", "s", [("x", ref("o", "p"))]) for i in range(1, 9)] + [delta("n", 7 * day, "a", "s", [("negates", ref("d2", "negated_by"))])]))
    log = store.log()
    assert ids(log.until(3 * day).deltas) == ["d1", "d2"] and ids(log.until(5 * day).until(3 * day).deltas) == ids(log.until(3 * day).until(5 * day).deltas)
    assert "day" in log.until(3 * day).deltas._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert ids(filters.query(log, DeltaFilter(start=2 * day, end=4 * day))) == ["d3"] and ids(filters.query(log, DeltaFilter(start=2 * day, end=4 * day), 5 * day)) == ["d2", "d3"]
    assert ids(filters.query(log, DeltaFilter(start=2 * day, end=4 * day, include_negated=True))) == ["d2", "d3"]
    assert ids(hyperview.long_form(log, ["o"], 4 * day)) == ["d1", "d2", "d3"]


def test_bad_lines_of_a_feed(spark):
    good = to_feed(frame(spark, [delta("a", 1, "x", "s", [("r", 1), ("t", ref("o", "c"))])]))
    lines = good.unionAll(spark.createDataFrame([("{not json",), (None,), ("[1]",), ("7",), ("",)], "value string"))
    assert ids(from_feed(lines).where("id IS NOT NULL")) == ["a"] and from_feed(lines).count() == 1
    from hyperdelta.sources.log import bad_lines

    assert sorted(str(r["value"]) for r in bad_lines(lines).collect()) == ["", "7", "None", "[1]", "{not json"]


def test_versions_can_be_stored(spark, tmp_path):
    versions = Versions()
    for name, version in (("A", 1), ("B", 2), ("C", None)):
        versions.register(HyperSchema("s", name, version=version))
    versions.register(HyperSchema("t", "T"))
    versions.table(spark).write.parquet(str(tmp_path / "versions"))
    again = Versions.of(spark.read.parquet(str(tmp_path / "versions")))
    assert all(again.history(i) == versions.history(i) and again.latest(i) == versions.latest(i) for i in ("s", "t", "none"))


def test_depth_of_stacked_diamonds():
    """Two ways at each of sixty levels: the depth is found without going every way."""
    registry = {"end": HyperSchema("end", "End")}
    for i in range(60):
        below = f"top{i - 1}" if i else "end"
        registry |= {f"{side}{i}": HyperSchema(f"{side}{i}", side, {"x": Rule(below)}) for side in ("left", "right")}
        registry[f"top{i}"] = HyperSchema(f"top{i}", "Top", {"a": Rule(f"left{i}"), "b": Rule(f"right{i}")})
    assert depth("top59", registry) == 121 and depth("end", registry) == 1 and depth("none", registry) == 0


def test_traversal(spark):
    """From posts by their comments to who is named there, with a condition on the way; a retracted step is not taken."""
    rows = [
        delta("d1", 1, "a", "s", [("post", ref("p1", "comments")), ("comment", ref("c1", "post"))]), delta("d2", 2, "a", "s", [("post", ref("p1", "comments")), ("comment", ref("c2", "post"))]),
        delta("d3", 3, "a", "s", [("post", ref("p2", "comments")), ("comment", ref("c3", "post"))]), delta("d4", 4, "a", "s", [("comment", ref("c1", "author")), ("author", ref("ann", "wrote"))]),
        delta("d5", 5, "a", "s", [("comment", ref("c2", "author")), ("author", ref("bob", "wrote"))]), delta("d6", 6, "a", "s", [("comment", ref("c3", "author")), ("author", ref("ann", "wrote"))]),
        delta("d7", 7, "a", "s", [("comment", ref("c1", "score")), ("score", 5)]), delta("d8", 8, "a", "s", [("comment", ref("c3", "score")), ("score", 1)]), delta("n", 9, "a", "s", [("negates", ref("d2", "negated_by"))]),
    ]
    log = DeltaLog(frame(spark, rows))
    long, plain = hyperview.long_form(log), hyperview.long_form(log, negation="none")
    reached = lambda l, *test: sorted(map(tuple, hyperview.hop(l, test[0] if test else hyperview.hop(l, start, "comments", "comment"), "author", "author").collect()))
    start = hyperview.starting(spark.createDataFrame([("p1",), ("p2",), ("p2",)], "object_id string"))
    assert reached(long) == [("p1", "ann"), ("p2", "ann")] and reached(plain) == [("p1", "ann"), ("p1", "bob"), ("p2", "ann")]
    liked = hyperview.having(long, hyperview.hop(long, start, "comments", "comment"), "score", P.number("score") > 2)
    assert reached(long, liked) == [("p1", "ann")]
