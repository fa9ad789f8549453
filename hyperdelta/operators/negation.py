"""Which deltas are retracted, when retractions can be retracted themselves.

A delta is retracted if some live retraction of it exists; a retraction is live unless it is retracted. On acyclic logs this
has one solution. It is not monotone, so no recursive query gives it; it is peeled instead, by joins: retractions that nothing
(undecided) retracts are live, their targets are retracted, the targets' own retractions then count no more, and so on. Most
chains are short and gone after LAYERS rounds. What is left is parted into connected components, and each is solved by one task, many
at once, so a long chain costs no more rounds; a component too large for a task is peeled on. What has a cycle, or hangs on one, is
undetermined, and counts as not retracted.

The log is read once, in parallel, for its narrow table of retractions.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..graph import components
from ..sources.log import DeltaLog

#: Retractions of one component that a task solves; a larger component is peeled by joins to its end.
ONE_TASK = 1_000_000
#: Rounds of joins before what is left is parted into components. Retractions of small components that a task solves together.
LAYERS, TOGETHER = 3, 100_000


def _edges(log: DeltaLog, asof: int | None, authors: list[str] | None) -> DataFrame:
    edges = log.negations
    if asof is not None:
        edges = edges.where(F.col("timestamp") <= asof)
    if authors is not None:
        edges = edges.where(F.col("author").isin(authors) if authors else F.lit(False))
    return edges


def solve(pairs: list[tuple[str, str]]) -> dict[str, bool | None]:
    """Of each target of (negator, target) pairs: retracted, or not, or undetermined (None)."""
    by, of = defaultdict(set), defaultdict(set)
    for negator, target in pairs:
        by[target].add(negator)
        of[negator].add(target)
    open_ = {t: len(n) for t, n in by.items()}  # retractions that may still be live
    state: dict[str, bool | None] = dict.fromkeys(by)
    queue = deque((n, True) for n in of if n not in by)
    while queue:
        node, live = queue.popleft()
        for t in of.get(node, ()):
            if state[t] is not None:
                continue
            open_[t] -= not live
            if live or not open_[t]:
                state[t] = live
                queue.append((t, not live))
    return state


def _peel(left: DataFrame, rounds: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """(tables of retracted ids, edges that are still undecided) by joins; a round settles one more layer of retractions of retractions."""
    gone: list[DataFrame] = []
    while rounds is None or len(gone) < rounds:
        targets = left.select(F.col("target_id").alias("negator_id")).distinct()
        hit = cut(left.join(targets, "negator_id", "left_anti").select("target_id").distinct())
        if hit.isEmpty():
            break
        gone.append(hit)
        rest = left.join(hit, "target_id", "left_anti")
        left = cut(rest.join(hit.withColumnRenamed("target_id", "negator_id"), "negator_id", "left_anti"))
    return gone, left


def by_component(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """edges (negator_id, target_id, ...) with their component: of components with at most `most` edges, and of larger ones."""
    found = components(edges.select(F.col("negator_id").alias("a"), F.col("target_id").alias("b"))).withColumnRenamed("node", "target_id")
    # an edge from a delta to itself alone is a component of its own
    named = cut(edges.join(found, "target_id", "left").withColumn("component", F.coalesce("component", "target_id")))
    large = cut(named.groupBy("component").count().where(F.col("count") > most).select("component"))
    return named.join(large, "component", "left_anti"), named.join(large, "component", "left_semi")


def each_component(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole components, about TOGETHER rows at a time, from batches that are sorted by component."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= TOGETHER:
            rows = pd.concat(held)
            open_ = rows["component"] == rows["component"].iloc[-1]  # may go on
            held = [rows[open_]]
            if not open_.all():
                yield rows[~open_]
    if held:
        yield pd.concat(held)


def _settled(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retracted ids, undetermined ids, all edges), the ids as target_id."""
    every = cut(edges.select("negator_id", "target_id").distinct())
    gone, left = _peel(every, LAYERS)
    loops = left.select("target_id").limit(0)
    if len(gone) == LAYERS and not left.isEmpty():

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in each_component(batches):
                found = [(t, s is None) for t, s in solve(list(zip(rows["negator_id"], rows["target_id"]))).items() if s is not False]
                yield pd.DataFrame(found, columns=["target_id", "open"])

        small, left = by_component(left, ONE_TASK)
        sorted_ = small.repartition("component").sortWithinPartitions("component")
        solved = cut(sorted_.mapInPandas(run, "target_id string, open boolean"))
        gone.append(solved.where("NOT open").select("target_id"))
        loops = solved.where("open").select("target_id")
        more, left = _peel(cut(left.select("negator_id", "target_id")))
        gone += more
    loops = loops.unionAll(left.select("target_id").distinct())
    return reduce(DataFrame.unionAll, gone, every.select("target_id").limit(0)), loops, every


def _verdicts(edges: DataFrame) -> DataFrame:
    """(target_id, negated, undetermined) of every target."""
    gone, loops, every = _settled(edges)
    marks = gone.select("target_id", F.lit(1).alias("m")).unionAll(loops.select("target_id", F.lit(2).alias("m")))
    rows = every.select("target_id", F.lit(0).alias("m")).unionAll(marks).groupBy("target_id").agg(F.max("m").alias("m"))
    return rows.select("target_id", (F.col("m") == 1).alias("negated"), (F.col("m") == 2).alias("undetermined"))


def negated_ids(log: DeltaLog, asof: int | None = None, mode: str = "full", authors: list[str] | None = None) -> DataFrame:
    """(id) of the retracted deltas, whether or not the log holds them.

    asof: only retractions up to that time count. authors: only theirs do. mode 'single_pass' retracts every target of any
    retraction, retracted or not.
    """
    edges = _edges(log, asof, authors)
    if mode == "single_pass":
        return edges.select(F.col("target_id").alias("id")).distinct()
    if mode != "full":
        raise ValueError(f"mode {mode!r} is neither 'full' nor 'single_pass'")
    return _settled(edges)[0].select(F.col("target_id").alias("id"))


def live(log: DeltaLog, asof: int | None = None, mode: str = "full", authors: list[str] | None = None) -> DeltaLog:
    """The log up to a time without what is retracted by then. What is retracted later is still there."""
    gone = negated_ids(log, asof, mode, authors)
    return DeltaLog(log.until(asof).deltas.join(gone, "id", "left_anti"))


def unretracted(log: DeltaLog, asof: int | None = None, mode: str = "full") -> tuple[DeltaLog, int]:
    """(live(), deltas of the log up to the time) for a log that is read again and again, or that is large: its deltas are not exchanged, only
    ids of retractions and retracted deltas.

    A sieve of the retracted ids lets through what is surely not retracted. Of the rest, the ids that are not retracted after all, a few in
    ten thousand of the log, are found by an exact join, kept, and joined by broadcast.
    """
    rows = log.until(asof)
    gone = cut(_gone(log, asof, mode))
    found = sieve(gone)
    if found is None:
        return DeltaLog(rows.deltas.join(gone, "id", "left_anti")), rows.deltas.count()
    bits, test = found
    # one pass: the ids that may be retracted, and under null how many others there are
    maybe = cut(rows.deltas.select("id").join(bits, F.lit(True), "cross").groupBy(F.when(test("id"), F.col("id")).alias("id")).count())
    size = maybe.agg(F.sum("count")).first()[0] or 0
    spared = cut(maybe.where("id IS NOT NULL").join(gone, "id", "left_anti").select(F.col("id").alias("_spared")))
    few = F.broadcast(spared) if spared.count() <= BROADCAST else spared
    both = rows.deltas.join(few, F.col("id") == F.col("_spared"), "left")
    return DeltaLog(both.join(bits, ~test("id") | F.col("_spared").isNotNull()).select(*rows.deltas.columns)), size


def _gone(log: DeltaLog, asof: int | None, mode: str) -> DataFrame:
    """negated_ids(), where most retractions are not retracted: these count at once, and of the others only those whose retraction is not
    among these are solved."""
    if mode != "full":
        return negated_ids(log, asof, mode)
    edges = cut(_edges(log, asof, None).select("negator_id", "target_id"))
    targeted = sieve(edges.select(F.col("target_id").alias("id")), 19)
    if targeted is None:
        return _settled(edges)[0].select(F.col("target_id").alias("id"))
    bits, test = targeted
    sure = edges.join(bits, ~test("negator_id")).select(F.col("target_id").alias("id"))
    open_ = edges.join(bits, test("negator_id")).select("negator_id", "target_id")
    negates = sieve(open_.select(F.col("negator_id").alias("id")), 19)
    void = sure if negates is None else sure.join(negates[0], negates[1]("id")).select("id")
    left = cut(open_.join(void.withColumnRenamed("id", "negator_id"), "negator_id", "left_anti"))
    if left.isEmpty():
        return sure
    return sure.unionAll(_settled(left)[0].select(F.col("target_id").alias("id")))


#: Ids that a sieve is made of at most: their hashes come to the driver, eight bytes each. Ids that are joined by broadcast at most.
SIEVED, BROADCAST = 8_000_000, 200_000
#: Bits of the hash that the sieve's four bits come from; the lowest choose the word.
SHIFTS = (24, 32, 40, 48)


def sieve(ids: DataFrame, most: int = 21) -> tuple[DataFrame, Callable[[str], Column]] | None:
    """(a row to be joined by broadcast, and beside it a test of a column of ids): false only if the id is not among ids (id), true for all of
    these and a few in ten thousand others. None if there are too many ids.

    A Bloom filter that sets four bits of one word for an id, of 2 ** most words at most: 16 MB. With fewer words for so many ids more is let through.
    """
    hashes = ids.where("id IS NOT NULL").select(F.xxhash64("id").alias("h"))
    found = hashes.limit(SIEVED + 1).toArrow()["h"]
    if len(found) > SIEVED:
        return None
    words = 1 << max(6, min(most, int(len(found) // 2).bit_length()))
    bits = np.zeros(words, np.int64)
    for chunk in found.chunks:
        h = chunk.to_numpy()
        np.bitwise_or.at(bits, h & (words - 1), reduce(np.bitwise_or, (np.int64(1) << ((h >> at) & 63) for at in SHIFTS)))
    del found, hashes
    pa.default_memory_pool().release_unused()
    row = pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))})

    def test(column: str) -> Column:
        own = F.xxhash64(column)
        mask = reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(own, at).bitwiseAND(F.lit(63)).cast("int")) for at in SHIFTS))
        word = F.get("_bits", own.bitwiseAND(F.lit(words - 1)).cast("int"))
        return F.col(column).isNotNull() & (word.bitwiseAND(mask) == mask)

    return F.broadcast(ids.sparkSession.createDataFrame(row)), test


def marked(log: DeltaLog, asof: int | None = None, authors: list[str] | None = None) -> DataFrame:
    """The log up to a time with a column `negated`: for audits."""
    gone = negated_ids(log, asof, "full", authors).withColumn("negated", F.lit(True))
    return log.until(asof).deltas.join(gone, "id", "left").withColumn("negated", F.coalesce("negated", F.lit(False)))


def states(log: DeltaLog, asof: int | None = None, authors: list[str] | None = None) -> DataFrame:
    """(id, negated, negated_by, negation_timestamp, was_restored, undetermined) of every delta that some retraction targets.

    negated_by is the live retraction with the latest time, the first to arrive of equals; null unless negated. was_restored:
    it has retractions, but none counts.
    """
    edges = _edges(log, asof, authors)
    verdicts = cut(_verdicts(edges))
    dead = verdicts.where("negated OR undetermined").select(F.col("target_id").alias("negator_id"))
    by = edges.join(dead, "negator_id", "left_anti").groupBy("target_id").agg(
        F.max_by(F.struct("negator_id", "timestamp"), F.struct("timestamp", -F.col("seq"))).alias("n")
    )
    out = verdicts.join(by, "target_id", "left")
    return out.select(
        F.col("target_id").alias("id"), "negated", F.when(F.col("negated"), F.col("n.negator_id")).alias("negated_by"),
        F.when(F.col("negated"), F.col("n.timestamp")).alias("negation_timestamp"), (~F.col("negated") & ~F.col("undetermined")).alias("was_restored"), "undetermined",
    )


def is_negated(log: DeltaLog, id: str, asof: int | None = None) -> bool:
    """Of an id that is not known: False."""
    return not negated_ids(log, asof).where(F.col("id") == id).isEmpty()
