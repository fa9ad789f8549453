"""The log as of a time: views, snapshots, timelines, replay. Retractions count from their own time on, never before."""

from __future__ import annotations

import itertools
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..sources.log import DeltaLog
from .filters import DeltaFilter, query
from .hyperview import Roots, long_form
from .negation import ONE_TASK, by_component, each_component, live, negated_ids


def view_at(log: DeltaLog, roots: Roots, asof: int, selector: str = "by_target_context") -> DataFrame:
    """The long form as of a time."""
    return long_form(log, roots, asof, selector=selector)


def snapshot(log: DeltaLog, asof: int) -> DataFrame:
    """One row: timestamp, delta_count (up to it) and negated_count (ids that some retraction up to it targets)."""
    rows = log.until(asof)
    deltas = rows.deltas.agg(F.count(F.lit(1)).alias("delta_count"), F.lit(1).alias("one"))
    gone = rows.negations.agg(F.countDistinct("target_id").alias("negated_count"), F.lit(1).alias("one"))
    return deltas.join(gone, "one").select(F.lit(asof).cast("long").alias("timestamp"), "delta_count", "negated_count")


def stats_at(log: DeltaLog, asof: int) -> DataFrame:
    """One row: total deltas up to a time, those effectively retracted, those active, authors, systems.

    A retraction of an id that the log does not hold retracts no delta of it.
    """
    rows = log.until(asof)
    gone = negated_ids(log, asof).withColumn("gone", F.lit(1))
    joined = rows.deltas.select("id", "author", "system").join(gone, "id", "left")
    total = F.count(F.lit(1))
    return joined.agg(
        total.alias("total"), F.count("gone").alias("negated"), (total - F.count("gone")).alias("active"),
        F.countDistinct("author").alias("authors"), F.countDistinct("system").alias("systems"),
    )


def _touching(log: DeltaLog, roots: Roots) -> DataFrame:
    """(object_id, timestamp, seq, id) of live deltas that refer to the objects, once each."""
    refs = live(log).references
    if roots is not None:
        refs = refs.join(roots, "object_id", "left_semi") if isinstance(roots, DataFrame) else refs.where(F.col("object_id").isin(roots) if roots else F.lit(False))
    return refs.select("object_id", "timestamp", "seq", "id").distinct()


def timeline(log: DeltaLog, roots: Roots = None) -> DataFrame:
    """(object_id, timestamp): the distinct times of live deltas that refer to each object."""
    return _touching(log, roots).select("object_id", "timestamp").distinct()


def replay_times(log: DeltaLog, roots: Roots = None, start: int = 0, end: int | None = None, most: int = 100) -> DataFrame:
    """(object_id, timestamp, step): the times of a replay. Of n times in range, every floor(n / most)-th from the first, all if n is at most `most`."""
    times = timeline(log, roots).where(F.col("timestamp") >= start)
    if end is not None:
        times = times.where(F.col("timestamp") <= end)
    of = Window.partitionBy("object_id")
    ranked = times.withColumns({"row": F.row_number().over(of.orderBy("timestamp")) - 1, "n": F.count(F.lit(1)).over(of)})
    every = F.when(F.col("n") > most, F.floor(F.col("n") / most)).otherwise(1).cast("int")
    return ranked.where(F.col("row") % every == 0).select("object_id", "timestamp", F.floor(F.col("row") / every).alias("step"))


def replay_counts(log: DeltaLog, times: DataFrame) -> DataFrame:
    """(object_id, timestamp, n): how many deltas show on an object at each of its times (object_id, timestamp).

    Retractions are judged as of each time, exactly: a count is that of the view as of that time. The intervals of a delta's life come
    from the changes of its state, and a count is a running sum of births and deaths, so nothing is rescanned for each time.
    """
    changes = lives(log)
    shown = log.references.where("property IS NOT NULL").select("object_id", "id", "timestamp")
    born = shown.join(changes, "id", "left")
    steps = born.select("object_id", F.explode(F.coalesce("changes", F.array(F.struct(F.col("timestamp").alias("at"), F.lit(1).alias("by"))))).alias("c")).select("object_id", F.col("c.at").alias("at"), F.col("c.by").alias("by"))
    points = times.select("object_id", F.col("timestamp").alias("at"), F.lit(0).alias("by"), F.lit(1).alias("asked"))
    both = steps.withColumn("asked", F.lit(0)).unionByName(points)
    run = both.withColumn("n", F.sum("by").over(Window.partitionBy("object_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    return run.where("asked = 1").select("object_id", F.col("at").alias("timestamp"), "n").distinct()


def timeline_of(edges: list[tuple[str, str, int]]) -> dict[str, list[tuple[int, bool]]]:
    """Of each target of (negator, target, time): when it becomes retracted (True) or live again (False).

    At each time only what lies below the new retractions is decided anew. What has a cycle, or hangs on one, counts as live.
    """
    by: dict[str, set[str]] = defaultdict(set)
    of: dict[str, set[str]] = defaultdict(set)
    state: dict[str, bool | None] = {}
    out: dict[str, list[tuple[int, bool]]] = defaultdict(list)
    for at, new in itertools.groupby(sorted(edges, key=lambda e: e[2]), key=lambda e: e[2]):
        below = set()
        for negator, target, _ in new:
            by[target].add(negator)
            of[negator].add(target)
            below.add(target)
        todo = list(below)
        while todo:
            for t in of.get(todo.pop(), ()):
                if t not in below:
                    below.add(t)
                    todo.append(t)
        was = {t: state.get(t) is True for t in below}
        state.update(dict.fromkeys(below))
        # retractions that may still be live: not those known to be retracted
        left = {t: sum(n in below or state.get(n) is not True for n in by[t]) for t in below}
        sure = {n for t in below for n in by[t] if n not in below and state.get(n, False) is False}
        free = [t for t in below if not left[t]]
        state.update(dict.fromkeys(free, False))
        ready = deque((n, True) for n in (*sure, *free))
        while ready:
            node, live_ = ready.popleft()
            for t in of.get(node, ()):
                if t in below and state[t] is None:
                    left[t] -= not live_
                    if live_ or not left[t]:
                        state[t] = live_
                        ready.append((t, not live_))
        for t in below:
            if (state[t] is True) != was[t]:
                out[t].append((at, state[t] is True))
    return out


def lives(log: DeltaLog) -> DataFrame:
    """(id, changes): of each delta that some retraction targets, when it appears (by = 1) and goes (by = -1) again.

    A delta whose retractions are not retracted themselves goes with the first of them. The others are gone through in the order of
    time, each component of retractions in one task, however deep it is; what has a cycle at a time is live then.
    """
    edges = cut(log.negations.select("negator_id", "target_id", "timestamp").distinct())
    targets = edges.select(F.col("target_id").alias("negator_id")).distinct()
    deep = cut(edges.join(targets, "negator_id", "left_semi").select("target_id").distinct())  # retracted by what is retracted
    born = log.deltas.select(F.col("id").alias("target_id"), F.col("timestamp").alias("born"))
    change = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    none = F.array().cast("array<struct<at:long,by:int>>")
    first = edges.join(deep, "target_id", "left_anti").groupBy("target_id").agg(F.min("timestamp").alias("gone")).join(born, "target_id")
    plain = first.select(F.col("target_id").alias("id"), F.when(F.col("gone") > F.col("born"), F.array(change(F.col("born"), 1), change(F.col("gone"), -1))).otherwise(none).alias("changes"))
    # the retractions of these, and all that these hang on: what retracts a retraction of theirs, and so on up
    chain = edges.join(deep, "target_id", "left_semi")
    upper = edges.join(chain.select(F.col("negator_id").alias("target_id")).distinct(), "target_id", "left_semi")
    small, large = by_component(cut(chain.unionAll(upper).distinct()), ONE_TASK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in each_component(batches):
            found = timeline_of(list(zip(rows["negator_id"], rows["target_id"], rows["timestamp"].tolist())))
            yield pd.DataFrame([(t, [x for x, _ in c], [g for _, g in c]) for t, c in found.items()], columns=["target_id", "at", "gone"])

    sorted_ = small.unionAll(large).repartition("component").sortWithinPartitions("component")
    found = deep.join(sorted_.mapInPandas(run, "target_id string, at array<long>, gone array<boolean>"), "target_id", "left").join(born, "target_id")
    # as of its birth, what came before has been settled; what never changes has no row
    pairs = F.coalesce(F.arrays_zip("at", "gone"), F.array().cast("array<struct<at:long,gone:boolean>>"))
    early = F.filter(pairs, lambda c: c["at"] <= F.col("born"))
    start = F.when(F.coalesce(F.try_element_at(early, F.lit(-1))["gone"], F.lit(False)), none).otherwise(F.array(change(F.col("born"), 1)))
    later = F.transform(F.filter(pairs, lambda c: c["at"] > F.col("born")), lambda c: F.struct(c["at"].alias("at"), F.when(c["gone"], -1).otherwise(1).alias("by")))
    return plain.unionAll(found.select(F.col("target_id").alias("id"), F.concat(start, later).alias("changes")))


def property_changes(log: DeltaLog, roots: Roots, property: str, value: Column) -> DataFrame:
    """(object_id, id, timestamp, seq, value, previous) of live deltas under a property, in time order; previous is the value before."""
    rows = live(log).references.where(F.col("property") == property)
    if roots is not None:
        rows = rows.join(roots, "object_id", "left_semi") if isinstance(roots, DataFrame) else rows.where(F.col("object_id").isin(roots))
    rows = rows.select("object_id", "id", "timestamp", "seq", value.alias("value")).dropDuplicates(["object_id", "id"])
    return rows.withColumn("previous", F.lag("value").over(Window.partitionBy("object_id").orderBy("timestamp", "seq")))


def compare(log: DeltaLog, roots: Roots, before: int, after: int) -> DataFrame:
    """(object_id, property, n_before, n_after, added) over two times; added may be negative."""
    a, b = (long_form(log, roots, t).groupBy("object_id", "property").agg(F.count(F.lit(1)).alias(n)) for t, n in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, ["object_id", "property"], "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_before", "n_after")}
    return both.select("object_id", "property", *(v.alias(c) for c, v in n.items()), (n["n_after"] - n["n_before"]).alias("added"))


def origin(log: DeltaLog, roots: Roots = None) -> DataFrame:
    """(object_id, id, timestamp) of the earliest live delta that refers to each object; of equal times the first to arrive."""
    first = F.min_by(F.struct("id", "timestamp"), F.struct("timestamp", "seq")).alias("d")
    return _touching(log, roots).groupBy("object_id").agg(first).select("object_id", "d.id", "d.timestamp")


def query_at(log: DeltaLog, where: DeltaFilter, asof: int) -> DataFrame:
    return query(log, where, asof)
