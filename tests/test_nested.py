"""What nested views move and keep, and that the texts that they move give every value back."""

import math
import os
import re

import pytest
from hyperdelta import queries
from hyperdelta.model import delta, frame, ref
from hyperdelta.operators import hyperview
from hyperdelta.plans.schema import HyperSchema, Registry, Rule
from hyperdelta.sources.log import DeltaLog


def kept(spark):
    """Bytes below the checkpoint folder."""
    place = spark.conf.get("spark.checkpoint.dir")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(place) for f in files)


def exchanged(df):
    """The columns of each exchange of the plan."""
    jvm = df.sparkSession.sparkContext._jvm
    plan = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)


def check_moved(spark, sf, name):
    before = kept(spark)
    df = queries.QUERIES[name](spark, sf)
    assert kept(spark) - before < 200_000  # ids and the views of a few nations, not the orders' deltas
    moved = exchanged(df)
    assert 0 < len(moved) <= 8 and not any(re.search(r"\b(pointers|props)#", x) for x in moved)  # all of an order meets in one exchange, as texts


def test_depth3_moves_texts_and_keeps_ids(spark, sf):
    check_moved(spark, sf, "nested_depth3_all")


def test_retracted_moves_no_whole_deltas(spark, sf):
    """Retracted deltas are left out where the log is read; only ids of retractions are joined."""
    moved = exchanged(queries.QUERIES["nested_retracted"](spark, sf))
    assert moved and not any(re.search(r"\b(pointers|props|d)#", x) for x in moved)


@pytest.mark.parametrize("part, few", [(40, 1000), (100_000, 1000), (40, 2)])
def test_views_of_retracted_deltas(spark, monkeypatch, part, few):
    """Objects that meet in many parts or one, views that are few or many: as the definition says, roots from a list or a table."""
    monkeypatch.setattr(hyperview, "PART", part)
    monkeypatch.setattr(hyperview, "FEW", few)
    rows = [delta(f"n{i}", 1, "a", "s", [("of", ref(f"in/{i}", "name")), ("v", f"name {i}")]) for i in range(12)]
    rows += [delta(f"l{i}", 1, "a", "s", [("of", ref(f"o/{i}", "link")), ("to", ref(f"in/{i % 12}", "back"))]) for i in range(60)]
    rows += [delta(f"v{i}", 1, "a", "s", [("of", ref(f"o/{i}", "value")), ("v", float(i))]) for i in range(60)]
    undo = {f"l{i}" for i in range(0, 60, 3)} | {f"n{i}" for i in range(0, 12, 5)} | {f"v{i}" for i in range(0, 60, 7)}
    again = {x for x in undo if int(x[1:]) % 2}
    rows += [delta(f"x/{x}", 2, "a", "s", [("negates", ref(x, "negated_by"))]) for x in sorted(undo)]
    rows += [delta(f"y/{x}", 3, "a", "s", [("negates", ref(f"x/{x}", "negated_by"))]) for x in sorted(again)]
    registry = Registry()
    registry.register(HyperSchema("leaf", "Leaf", properties=("name",)))
    registry.register(HyperSchema("top", "Top", {"to": Rule("leaf")}))
    gone = undo - again
    wanted = {}
    for i in range(0, 60, 2):
        shown = {"link": [f"l{i}"], "value": [f"v{i}"]}
        inner = None if f"n{i % 12}" in gone else f"n{i % 12}"
        wanted[f"o/{i}"] = ({k: v for k, v in shown.items() if v[0] not in gone}, inner if f"l{i}" not in gone else None)
    wanted = {k: v for k, v in wanted.items() if v[0]}
    ids = [f"o/{i}" for i in range(0, 60, 2)]
    log = DeltaLog(frame(spark, rows))
    for roots in (ids, spark.createDataFrame([(i,) for i in ids], "object_id string")):
        got = {}
        for r in hyperview.nested(log, "top", registry, roots).collect():
            views = [p["view"]["to"] for ds in r["props"].values() for d in ds for p in d["pointers"] if p["view"]]
            got[r["object_id"]] = ({k: [d["id"] for d in ds] for k, ds in r["props"].items()}, views[0]["props"]["name"][0]["id"] if views else None)
        assert got == wanted


ODD = ["", "\x04", "a\x04b\x05\x00", '"}],"a":1', "back\\slash\n\t", "  \U0001f600 é", "x" * 100_000, "null"]
NUMBERS = [0.0, -0.0, 1e-320, 1.7976931348623157e308, 0.1, 2.0**53 + 2, math.inf, -math.inf, math.nan]


@pytest.mark.parametrize("own", ["o/1", '"a"', "\x04", '":"', "e"])
def test_values_come_back(spark, own):
    """Any text, number and id, on the object itself and in what it opens; a missing object opens nothing, the object itself neither."""
    said = [*ODD, *NUMBERS, True, False]
    rows = [delta(f"d{i}{own}", 1, "a\x04", "s", [("of", ref(own, "said")), ("v", x), ("bare", ref("z"))]) for i, x in enumerate(said)]
    rows += [delta(f"e{i}{own}", 1, "a", "s", [("of", ref("in/2", "said")), ("v", x), ("up", ref(own))]) for i, x in enumerate(said)]
    rows += [delta("twice", 1, "a", "s", [("of", ref(own, "l")), ("again", ref(own, "m")), ("to", ref("in/2")), ("to", ref("none")), ("too", ref("in/2")), ("to", ref(own))])]
    leaf, top = HyperSchema("leaf", "Leaf"), HyperSchema("top", "Top", {"to": Rule("leaf"), "too": Rule("leaf")})
    registry = Registry()
    registry.register(leaf)
    registry.register(top)
    log = DeltaLog(frame(spark, rows))
    roots = spark.createDataFrame([(own,), ("absent",)], "object_id string")
    plain = {r["id"]: r for r in log.deltas.collect()}
    values = lambda r: [repr(tuple(p[c] for c in ("pos", "role", "kind", "ref_id", "ref_context", "str", "num", "bool"))) for p in r["pointers"]]
    same = lambda d: all(d[c] == plain[d["id"]][c] for c in ("timestamp", "author", "system", "seq")) and values(d) == values(plain[d["id"]])

    (view,) = hyperview.nested(log, "top", registry, roots, negation="none").collect()
    assert view["object_id"] == own and set(view["props"]) == {"said", "l", "m"}
    assert [d["id"] for d in view["props"]["said"]] == [f"d{i}{own}" for i in range(len(said))]
    assert all(same(d) for ds in view["props"].values() for d in ds)
    long = hyperview.nested_long(log, "top", registry, roots, negation="none").collect()
    assert len(long) == len(said) + 2 and all(same(d) for d in long)
    for d in (view["props"]["l"][0], view["props"]["m"][0], *(d for d in long if d["id"] == "twice")):
        opened = [(p["view"]["to"], p["view"]["too"]) if p["view"] else None for p in d["pointers"]]
        assert [x and [v and v["object_id"] for v in x] for x in opened] == [None, None, ["in/2", None], None, [None, "in/2"], None]
        inner = opened[2][0]["props"]["said"]
        assert [x["id"] for x in inner] == [f"e{i}{own}" for i in range(len(said))] and all(same(x) for x in inner)
