import random

import pytest
from hyperdelta.model import delta, frame, ref
from hyperdelta.operators import negation
from hyperdelta.sources.log import DeltaLog


def make(spark, *edges, extra=()):
    """Deltas d..., and retractions (id, target, timestamp)."""
    ids = {t for _, t, _ in edges} - {n for n, _, _ in edges}
    rows = [delta(i, 1000, "a", "s", [("name", "x")]) for i in sorted(ids)] + list(extra)
    rows += [delta(n, t, "a", "s", [("negates", ref(target, "negated_by"))]) for n, target, t in edges]
    return DeltaLog(frame(spark, rows))


def negated(log, **how):
    return {r["id"] for r in negation.negated_ids(log, **how).collect()}


def test_chains(spark):
    log = make(spark, ("n1", "d1", 2000), ("n2", "n1", 3000), ("n3", "d2", 2000), ("m1", "d3", 2000), ("m2", "m1", 3000), ("m3", "m2", 4000))
    assert negated(log) == {"n1", "d2", "m2", "d3"}
    assert negated(log, mode="single_pass") == {"d1", "n1", "d2", "d3", "m1", "m2"}


def test_as_of(spark):
    log = make(spark, ("n1", "d1", 2000), ("n2", "n1", 3000))
    assert [("d1" in negated(log, asof=t)) for t in (1000, 2000, 3000)] == [False, True, False]


def test_concurrent_retractions_and_states(spark):
    log = make(spark, ("n1", "d1", 2000), ("n2", "d1", 2000), ("m1", "d2", 2000), ("m2", "m1", 2500))
    states = {r["id"]: r for r in negation.states(log).collect()}
    assert states["d1"]["negated"] and states["d1"]["negated_by"] == "n1" and states["d1"]["negation_timestamp"] == 2000
    assert states["d2"]["was_restored"] and states["d2"]["negated_by"] is None


def test_cycles_are_undetermined(spark):
    log = make(spark, ("n1", "n2", 1000), ("n2", "n1", 1000), ("n1", "d1", 1000), ("s", "s", 1000), ("x", "d2", 1000))
    assert negated(log) == {"d2"}
    assert {r["id"] for r in negation.states(log).collect() if r["undetermined"]} == {"n1", "n2", "d1", "s"}


def test_long_chain(spark):
    log = make(spark, ("c0", "d", 1), *[(f"c{i}", f"c{i - 1}", 1) for i in range(1, 205)])
    assert negated(log) == {f"c{i}" for i in range(203, -1, -2)} | {"d"}


def test_by_author_and_unknown(spark):
    log = make(spark, ("n1", "d1", 2000))
    assert negated(log, authors=["b"]) == set() and negated(log, authors=[]) == set() and negated(log, authors=["a"]) == {"d1"}
    assert not negation.is_negated(log, "nothing") and negation.is_negated(log, "d1")
    with pytest.raises(ValueError):
        negation.negated_ids(log, mode="other")


def brute(pairs):
    """Rounds of the definition, on an acyclic graph, until nothing changes."""
    state = {}
    for _ in range(len(pairs) + 2):
        state = {t: any(n2 == n and not state.get(n2, False) for n2, t2 in pairs if t2 == t for n in [n2]) for _, t in pairs}
    return state


@pytest.mark.parametrize("seed", range(30))
def test_solver_on_random_graphs(seed):
    random.seed(seed)
    n = random.randrange(2, 14)
    pairs = [(f"{i}", f"{random.randrange(i)}") for i in range(1, n) for _ in range(random.randrange(3))]
    random.shuffle(pairs)
    assert negation.solve(pairs) == brute(pairs)


def test_peel_agrees_with_one_task(spark, monkeypatch):
    random.seed(5)
    pairs = [(f"n{i}", f"n{random.randrange(i)}" if random.random() < 0.7 and i else f"d{i}") for i in range(60)] + [("p", "q"), ("q", "p"), ("q", "d1")]
    log = make(spark, *[(a, b, 1000) for a, b in dict(pairs).items()])
    one = sorted(map(tuple, negation.states(log).collect()), key=str)
    monkeypatch.setattr(negation, "ONE_TASK", 0)
    assert sorted(map(tuple, negation.states(log).collect()), key=str) == one


def random_log(spark, seed, n=40, loops=True):
    """Deltas and retractions at random times, of deltas, of retractions, and of each other in circles."""
    rng = random.Random(seed)
    edges = [(f"n{i}", rng.choice([f"d{rng.randrange(8)}", f"n{rng.randrange(n if loops else max(1, i))}"]), rng.randrange(1, 30) * 100) for i in range(n)]
    edges += [("p", "q", 300), ("q", "p", 900), ("q", "d1", 1200)] if loops else []
    ids = sorted({t for _, t, _ in edges if t.startswith("d")})
    rows = [delta(i, rng.randrange(1, 20) * 100, "a", "s", [("name", ref(f"o{i[1:]}", "name"))]) for i in ids]
    rows += [delta(a, max(t for n, _, t in edges if n == a), "a", "s", [("negates", ref(b, "negated_by")) for n, b, _ in edges if n == a]) for a in sorted({a for a, _, _ in edges})]
    edges = [(a, b, max(t for n, _, t in edges if n == a)) for a, b, _ in edges]
    return DeltaLog(frame(spark, rows)), edges


@pytest.mark.parametrize("layers, one_task", [(1, 1000), (3, 1000), (3, 2), (1, 0)])
def test_peel_components_and_solver_agree(spark, monkeypatch, layers, one_task):
    """Whatever is settled by joins, by components, or by joins after the components are too large."""
    monkeypatch.setattr(negation, "LAYERS", layers)
    monkeypatch.setattr(negation, "ONE_TASK", one_task)
    for seed in (1, 2):
        log, edges = random_log(spark, seed)
        want = negation.solve([(a, b) for a, b, _ in edges])
        got = {r["target_id"]: None if r["undetermined"] else r["negated"] for r in negation._verdicts(negation._edges(log, None, None)).collect()}
        assert got == want and None in want.values()
        assert negated(log) == {t for t, s in want.items() if s}


def test_the_log_is_scanned_by_all_its_tasks(spark, tmp_path):
    """No plan brings the scan of the log down to one task, and the number of retractions changes nothing."""
    log, _ = random_log(spark, 3)
    log.deltas.repartition(6).write.parquet(str(tmp_path / "log"))
    stored = DeltaLog(spark.read.parquet(str(tmp_path / "log")))
    plan = stored.negations.distinct()._jdf.queryExecution().toString() + negation.live(stored).deltas._jdf.queryExecution().toString()
    assert "Coalesce" not in plan and not any("coalesce(1)" in line for line in open(negation.__file__))


@pytest.mark.parametrize("seed", range(6))
def test_lives_are_the_states_as_of_each_time(spark, seed):
    """Against solving the log anew as of each time, with circles and deep chains."""
    from hyperdelta.operators import timetravel

    log, edges = random_log(spark, seed, 25)
    found = {r["id"]: [(c["at"], c["by"]) for c in r["changes"]] for r in timetravel.lives(log).collect()}
    born = {r["id"]: r["timestamp"] for r in log.deltas.collect()}
    assert found.keys() == {t for _, t, _ in edges} & born.keys()
    for id, changes in found.items():
        for at in sorted({t for _, _, t in edges} | {born[id]}):
            shows = at >= born[id] and negation.solve([(a, b) for a, b, t in edges if t <= at]).get(id) is not True
            assert sum(by for when, by in changes if when <= at) == shows


def test_replay_counts_are_those_of_the_views(spark):
    from hyperdelta.operators import timetravel

    log, _ = random_log(spark, 9, 30)
    times = spark.createDataFrame([(o["object_id"], t) for o in log.references.select("object_id").distinct().collect() for t in range(100, 3000, 700)], "object_id string, timestamp long")
    got = {(r["object_id"], r["timestamp"]): r["n"] for r in timetravel.replay_counts(log, times).collect()}
    for t in range(100, 3000, 700):
        want = {r["object_id"]: r["count"] for r in timetravel.view_at(log, None, t).groupBy("object_id").count().collect()}
        assert {o: n for (o, at), n in got.items() if at == t and n} == want


def test_a_chain_of_hundreds(spark):
    from hyperdelta.operators import timetravel

    log = make(spark, ("c0", "d", 10), *[(f"c{i}", f"c{i - 1}", 10 + i) for i in range(1, 300)])
    changes = {r["id"]: [(c["at"], c["by"]) for c in r["changes"]] for r in timetravel.lives(log).collect()}
    assert changes["c298"] == [(308, 1), (309, -1)] and changes["d"] == [(1000, 1)] and len(changes["c0"]) == 300


@pytest.mark.parametrize("sieved, words", [(8_000_000, None), (0, None), (8_000_000, 1)])
def test_unretracted_is_live(spark, monkeypatch, sieved, words):
    """By the sieve, without it, and with one that lets through much."""
    monkeypatch.setattr(negation, "SIEVED", sieved)
    if words is not None:
        monkeypatch.setattr(negation, "SHIFTS", (24,) * words)
    random.seed(11)
    pairs = {(f"n{i}", f"n{random.randrange(i)}" if random.random() < 0.6 and i else f"d{random.randrange(40)}") for i in range(120)}
    pairs |= {("p", "q"), ("q", "p"), ("q", "d1"), ("s", "s"), ("n3", "n5"), ("x", "d77")}
    log = make(spark, *[(a, b, 1000 + i % 7) for i, (a, b) in enumerate(sorted(pairs))], extra=[delta(f"e{i}", 1000, "a", "s", [("name", 1)]) for i in range(30)])
    for how in ({}, {"asof": 1003}, {"mode": "single_pass"}):
        rows, size = negation.unretracted(log, **how)
        assert size == log.until(how.get("asof")).deltas.count()
        got = sorted(r["id"] for r in rows.deltas.collect())
        assert got == sorted(r["id"] for r in negation.live(log, **how).deltas.collect())
