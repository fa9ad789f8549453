import pytest
from hyperdelta.operators.filters import DeltaFilter
from hyperdelta.queries import worked_example
from hyperdelta.service import Config, Service, decode_message, encode_message, valid_messages
from hyperdelta.sources.log import DeltaLog
from hyperdelta.streaming import subscribe as streaming
from pyspark.sql import functions as F


def test_service(spark, tmp_path):
    s = Service(spark, Config(str(tmp_path / "log"), "here"))
    s.create_object("ann", "m1", {"title": "One", "year": 1999, "gone": None}, timestamp=1000)
    s.create_relationship("ann", ("movie", "m1", "cast"), ("actor", "p1", "films"), timestamp=1100)
    assert s.get_object("m1") == {"id": "m1", "title": "One", "year": "1999", "cast": "p1"}
    assert s.update_object("ann", "m1", {"title": "Two"}, 2000) == 2
    assert s.get_object("m1")["title"] == "Two"
    assert [d["pointers"][1]["target"] for d in s.time_travel_query(1500, ["m1"])["deltas"]] == ["One", 1999, {"id": "p1", "context": "films"}]
    made = s.create_delta("bob", [{"role": "x", "target": {"id": "m1"}}, {"role": "ok", "target": True}], id="d", timestamp=2500)
    assert s.get_delta("d") == made and made["system"] == "here" and s.get_delta("none") is None
    s.negate_delta("bob", "d", "no", timestamp=2600)
    assert s.is_negated("d") and s.query_deltas(ids=["d"])["count"] == 0 and s.query_deltas(ids=["d"], includeNegated=True)["count"] == 1
    found = s.query_deltas(authors=["ann"], limit=1)
    assert found["count"] == 4 and len(found["deltas"]) == 1
    assert s.list_objects()[0] == "m1" and s.get_stats()["total"] == 7
    with pytest.raises(ValueError):
        s.query_deltas(colour="red")
    hash = s.register_schema("movie", "Movie", {"title": "string"})
    assert s.materialize_view("movie") == s.rebuild_view("movie") and not s.views.is_outdated("movie")
    assert s.register_schema("movie", "Movie", {"title": "string", "year": "integer"}) != hash and s.views.is_outdated("movie")
    with pytest.raises(LookupError):
        s.rebuild_view("unknown")
    with pytest.raises(LookupError):
        s.load_schema("unknown")


def test_messages(spark):
    assert decode_message(encode_message({"type": "PING", "timestamp": 1})) == {"type": "PING", "timestamp": 1}
    with pytest.raises(ValueError):
        decode_message('{"type": "PING"}')
    lines = spark.createDataFrame([('{"type":"A","timestamp":1}',), ('{"type":"","timestamp":1}',), ("{}",), ("no",), (None,)], "value string")
    assert valid_messages(lines).count() == 1


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    log, seen = worked_example(spark).deltas, []
    handle = lambda batch, n: seen.extend(r["id"] for r in batch.collect())
    run = lambda: streaming.subscribe(streaming.source(spark, str(tmp_path / "in")), handle, str(tmp_path / "cp"), DeltaFilter(authors=["bob"])).awaitTermination()
    log.where("seq < 4").write.parquet(str(tmp_path / "in"))
    run()
    log.where("seq >= 4").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(seen) == ["d4", "d5", "d6"]


@pytest.mark.parametrize("overflow, kept", [("drop_oldest", ["d5", "d6"]), ("drop_newest", ["d1", "d2"]), ("block", ["d1", "d2", "d3", "d4", "d5", "d6"])])
def test_overflow(spark, overflow, kept):
    burst, buffer = worked_example(spark).deltas, streaming.Buffer(2, overflow)
    assert sorted(r["id"] for r in streaming.kept(burst, buffer).collect()) == kept
    row = streaming.buffer_stats(burst, buffer).first()
    assert (row["received"], row["size"], row["dropped"]) == (6, len(kept), 0 if overflow == "block" else 4)


def test_overflow_error(spark):
    with pytest.raises(OverflowError):
        streaming.kept(worked_example(spark).deltas, streaming.Buffer(5, "error"))
    assert streaming.kept(worked_example(spark).deltas, streaming.Buffer(6, "error")).count() == 6
    assert streaming.buffer_stats(DeltaLog(worked_example(spark).deltas.limit(0)).deltas).first()["received"] == 0


def test_values_keep_their_kinds(spark, tmp_path):
    s = Service(spark, Config(str(tmp_path / "log"), "here"))
    s.create_object("ann", "m1", {"title": "One", "year": 1999, "seen": False}, timestamp=1000)
    assert s.update_object("ann", "m1", {"year": 2001, "seen": True, "title": None, "rating": 7.5}, 2000) == 6
    live = [d for d in s.get_object_deltas("m1")["deltas"]]
    assert {d["pointers"][1]["role"]: d["pointers"][1]["target"] for d in live} == {"year": 2001, "seen": True, "rating": 7.5}


def test_look_ups_with_and_without_the_index(spark, tmp_path):
    s = Service(spark, Config(str(tmp_path / "log"), "here"))
    for i in range(6):
        s.create_object(f"a{i % 2}", f"m{i % 3}", {"title": str(i)}, timestamp=1000 * (i + 1))
    gone = s.query_deltas(authors=["a0"])["deltas"][0]["id"]
    s.negate_delta("bob", gone, timestamp=9000)
    plain = Service(spark, Config(str(tmp_path / "log"), "here", use_index=False))
    for query in ({"targetIds": ["m1"]}, {"authors": ["a0"]}, {"targetContexts": ["title"], "authors": ["a1"], "timestampEnd": 4000}, {"authors": []}, {"authors": ["a0"], "includeNegated": True}, {"targetIds": ["m0"], "systems": ["other"]}):
        for asof in (None, 3000):
            assert s.query_deltas(asof, **query) == plain.query_deltas(asof, **query)
    assert s.query_deltas(authors=["a0"])["count"] == 2


def test_stored_views_outlive_the_session(spark, tmp_path):
    """Built by one session; read, updated and rebuilt by others; parents follow what they open."""
    start = lambda: Service(spark, Config(str(tmp_path / "log"), "here"))
    schemas = lambda s: (s.register_schema("actor", "Actor", {"name": "string"}), s.register_schema("movie", "Movie", {"title": "string", "actor": "actor"})) and s
    s = schemas(start())
    with pytest.raises(LookupError):
        s.get_stored_view("movie", "m1")
    s.create_object("ann", "m1", {"title": "One"}, timestamp=1000)
    s.create_object("ann", "p1", {"name": "Old"}, timestamp=1001)
    s.create_relationship("ann", ("movie", {"id": "m1"}["id"], "cast"), ("actor", "p1", "films"), timestamp=1100)
    s.materialize_view("movie")
    name = lambda v: [p["str"] for d in v["props"]["cast"][0]["pointers"][1]["view"]["actor"]["props"]["name"] for p in d["pointers"] if p["kind"] == "str"]
    s = schemas(start())
    assert name(s.get_stored_view("movie", "m1")) == ["Old"] and s.get_stored_view("movie", "m1") == s.get_view("movie", "m1")
    assert not s.views.is_outdated("movie")
    before = {d["id"] for d in s.query_deltas(includeNegated=True)["deltas"]}
    s.update_object("ann", "p1", {"name": "New"}, 2000)
    fresh = s.log.deltas.where(~F.col("id").isin(list(before))).select("id")
    assert name(s.get_stored_view("movie", "m1")) == ["Old"]
    schemas(start()).views.update(s.log, "movie", fresh)
    assert name(s.get_stored_view("movie", "m1")) == ["New"] and s.get_stored_view("movie", "none") is None
    assert s.views.vacuum("movie") == [] or name(s.get_stored_view("movie", "m1")) == ["New"]
    s.views.invalidate("movie")
    with pytest.raises(LookupError):
        s.views.get("movie")
    assert s.materialize_view("movie") > 0 and name(s.get_stored_view("movie", "m1")) == ["New"]


def test_two_writers_of_one_view(spark, tmp_path):
    s = Service(spark, Config(str(tmp_path / "log"), "here"))
    s.register_schema("any", "Any")
    s.create_object("ann", "m1", {"title": "One"}, timestamp=1000)
    s.materialize_view("any")
    number, buckets = s.views._state("any")
    with pytest.raises(Exception, match="exist"):
        s.views._commit("any", number, buckets)
    empty = Service(spark, Config(str(tmp_path / "none"), "here"))
    empty.register_schema("any", "Any")
    assert empty.materialize_view("any") == 0 and empty.get_stored_view("any", "m1") is None


def test_own_calls_by_name(spark, tmp_path):
    s = Service(spark, Config(str(tmp_path / "log"), "here"))
    s.add_resolver("titles", lambda service, author: [d["pointers"][1]["target"] for d in service.query_deltas(authors=[author])["deltas"]])
    s.call("create_object", author="ann", object_id="m", properties={"title": "One"}, timestamp=1000)
    assert s.call("titles", author="ann") == ["One"] and s.call("list_objects") == ["m"]
    with pytest.raises(LookupError):
        s.call("_persist", rows=[])
    with pytest.raises(ValueError):
        s.add_resolver("get_object", lambda service: None)


def test_slow_handlers_and_errors(spark):
    """A live consumer behind a buffer: slow, paused, failing, and each rule for what does not fit."""
    import threading

    deltas = worked_example(spark).deltas
    gate, seen, failed = threading.Event(), [], []

    def slow(d):
        gate.wait(20)
        if d["id"] == "d3":
            raise RuntimeError("no")
        seen.append(d["id"])

    s = streaming.Bounded(slow, streaming.Buffer(10), lambda d, e: failed.append((d["id"], str(e))))
    s.offer(deltas)
    assert s.stats()["received"] == 6 and not seen
    gate.set()
    assert s.drain(20) and seen == ["d1", "d2", "d4", "d5", "d6"] and failed == [("d3", "no")] and s.stats()["processed"] == 5 and s.stats()["failed"] == 1
    s.close()
    for overflow, kept in (("drop_oldest", ["d5", "d6"]), ("drop_newest", ["d1", "d2"])):
        got, warned = [], []
        s = streaming.Bounded(lambda d: got.append(d["id"]), streaming.Buffer(2, overflow, 100), on_warning=warned.append)
        s.pause()
        s.offer(deltas)
        assert s.stats()["dropped"] == 4 and warned
        s.resume()
        assert s.drain(20) and got == kept
        s.close()
    s = streaming.Bounded(lambda d: None, streaming.Buffer(2, "error"))
    s.pause()
    with pytest.raises(OverflowError):
        s.offer(deltas)
    s.close()
    with pytest.raises(RuntimeError):
        s.offer(deltas)
    got = []
    s = streaming.Bounded(lambda d: got.append(d["id"]), streaming.Buffer(1, "block"))
    s.offer(deltas)  # waits for the handler, so all come through
    assert s.drain(20) and got == ["d1", "d2", "d3", "d4", "d5", "d6"] and s.stats()["dropped"] == 0
    s.close()


def test_a_stream_over_a_store(spark, tmp_path):
    """The store's own folder as a source: its deltas once each, its index not among them; as a feed, and without repeats."""
    from hyperdelta.sources.log import Store

    store, got = Store(spark, str(tmp_path / "log")), []
    store.append(worked_example(spark).deltas)
    s = streaming.Bounded(lambda d: got.append(d["id"]), streaming.Buffer(100))
    streaming.subscribe(streaming.source(spark, store.path), s.offer, str(tmp_path / "cp"), DeltaFilter(authors=["bob"])).awaitTermination()
    assert s.drain(20) and sorted(got) == ["d4", "d5", "d6"]
    s.close()
    streaming.to_feed(streaming.source(spark, store.path), str(tmp_path / "feed"), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "feed")).collect()) == [f"d{i}" for i in range(1, 7)]
    worked_example(spark).deltas.write.parquet(str(tmp_path / "twice"))
    worked_example(spark).deltas.write.mode("append").parquet(str(tmp_path / "twice"))
    seen = []
    unique = streaming.distinct(streaming.source(spark, str(tmp_path / "twice")))
    streaming.subscribe(unique, lambda b, n: seen.extend(r["id"] for r in b.collect()), str(tmp_path / "cp3")).awaitTermination()
    assert sorted(seen) == [f"d{i}" for i in range(1, 7)]


def test_links(spark, tmp_path):
    from hyperdelta.model import delta, frame
    from hyperdelta.operators.replicate import Link, Links, Trust, replicate
    from hyperdelta.sources.log import Store

    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    a.append(frame(spark, [delta("a1", 1, "ann", "A", []), delta("a2", 2, "eve", "A", [])]))
    b.append(frame(spark, [delta("b1", 3, "bob", "B", []), delta("b2", 4, "eve", "B", [])]))
    links = Links()
    links.open("ab", Link(a, b, "A", "B", trust=(Trust(authors=("ann", "bob")),)))
    assert links.sync() == {"ab": {"sent": 2, "received": 1, "rejected": 1}}
    held = lambda s: sorted(r["id"] for r in s.read().collect())
    assert held(a) == ["a1", "a2", "b1"] and held(b) == ["a1", "a2", "b1", "b2"]
    assert links.sync()["ab"]["sent"] == 0 and links.names() == ["ab"]
    with pytest.raises(ValueError):
        links.open("ab", Link(a, b, "A", "B"))
    links.close("ab")
    assert links.sync() == {} and links.names() == []
    with pytest.raises(RuntimeError):
        links._all["ab"].sync()
    c = Store(spark, str(tmp_path / "c"))
    assert replicate(a, c, where=DeltaFilter(authors=["ann"]), audit=str(tmp_path / "audit"))["sent"] == 1
    assert Link(a, c, "A", "C", mode="pull").sync() == {"sent": 0, "received": 0, "rejected": 0}
    assert spark.read.parquet(str(tmp_path / "audit")).select("sent", "rejected", "latest").collect() == [(1, 0, 1)]
