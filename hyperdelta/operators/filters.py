"""Filters over the log. None does not constrain; an empty list matches nothing; all conditions hold together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointers as P
from ..sources.log import DeltaLog
from .negation import negated_ids

#: Longer lists of ids are joined rather than written into the condition.
INLINE = 1000


@dataclass(frozen=True)
class DeltaFilter:
    """target_ids and target_contexts may be met by different pointers of a delta. start and end are inclusive, in ms.
    predicate: a Column over a delta's columns, or SQL text."""

    ids: list[str] | None = None
    target_ids: list[str] | None = None
    target_contexts: list[str] | None = None
    authors: list[str] | None = None
    systems: list[str] | None = None
    start: int | None = None
    end: int | None = None
    predicate: Column | str | None = None
    include_negated: bool = False

    def condition(self) -> Column:
        """Everything but retractions; also good for streams. Conditions on plain columns come first and reach the scan."""
        tests = [F.lit(True)]
        for name, wanted in (("id", self.ids), ("author", self.authors), ("system", self.systems)):
            if wanted is not None:
                tests.append(F.col(name).isin(wanted) if wanted else F.lit(False))
        if self.start is not None:
            tests.append(F.col("timestamp") >= self.start)
        if self.end is not None:
            tests.append(F.col("timestamp") <= self.end)
        if self.target_ids is not None:
            tests.append(P.any_reference(ids=self.target_ids))
        if self.target_contexts is not None:
            tests.append(P.any_reference(contexts=self.target_contexts))
        if self.predicate is not None:
            tests.append(F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate)
        return reduce(lambda a, b: a & b, tests)


def query(log: DeltaLog, where: DeltaFilter = DeltaFilter(), asof: int | None = None) -> DataFrame:
    """The matching deltas; without retracted ones, unless the filter includes them. Retractions are judged as of `asof`."""
    kept, rows = where.condition(), log.until(asof)
    if where.start is not None or where.end is not None:
        rows = rows.between(where.start, where.end)
    if not where.include_negated:  # which may come from outside the range
        return rows.deltas.where(kept).join(negated_ids(log, asof), "id", "left_anti")
    return rows.deltas.where(kept)


def first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows to arrive; all for 0 or None."""
    ordered = rows.orderBy("seq")
    return ordered.limit(limit) if limit else ordered


def by_ids(log: DeltaLog, ids: list[str] | DataFrame) -> DataFrame:
    """The deltas with the ids, retracted or not, with `ord`: the place asked for. Missing ids are skipped.

    ids: a list, or a DataFrame (ord, id) of any size.
    """
    if not isinstance(ids, DataFrame):
        ids = log.deltas.sparkSession.createDataFrame(list(enumerate(ids)), "ord long, id string")
    return log.deltas.join(ids, "id")


def scan(log: DeltaLog, where: DeltaFilter | None = None, after: tuple[int, str] | None = None) -> DataFrame:
    """Deltas in the order of (timestamp, id), from a key on, itself included. Retractions are not applied."""
    rows = log.deltas if where is None else log.deltas.where(where.condition())
    if after:
        timestamp, id = after
        rows = rows.where((F.col("timestamp") > timestamp) | ((F.col("timestamp") == timestamp) & (F.col("id") >= id)))
    return rows.orderBy("timestamp", "id")


def ids_matching(log: DeltaLog, **criteria: list[str]) -> DataFrame:
    """(id) of the deltas that each given criterion (target_ids, target_contexts, authors, systems) matches, from the edges."""
    sets = []
    for name, column in (("target_ids", "ref_id"), ("target_contexts", "ref_context"), ("authors", "author"), ("systems", "system")):
        if criteria.get(name) is not None:
            wanted = criteria[name]
            source = log.edges.where("kind = 'ref'").withColumnRenamed("delta_id", "id") if column.startswith("ref") else log.deltas
            sets.append(source.where(F.col(column).isin(wanted) if wanted else F.lit(False)).select("id").distinct())
    if not sets:
        raise ValueError("no criterion")
    return reduce(lambda a, b: a.intersect(b), sets)


def cardinalities(log: DeltaLog) -> DataFrame:
    """One row: how many targets, contexts, authors and systems an index would have as keys, how many entries, and an estimate of its bytes."""
    refs = log.references
    targets = refs.agg(F.countDistinct("object_id").alias("target_ids"), F.countDistinct("property").alias("target_contexts"))
    own = log.deltas.agg(F.countDistinct("author").alias("authors"), F.countDistinct("system").alias("systems"), F.count(F.lit(1)).alias("entries"))
    both = own.withColumn("one", F.lit(1)).join(targets.withColumn("one", F.lit(1)), "one").drop("one")
    keys = F.col("target_ids") + F.col("target_contexts") + F.col("authors") + F.col("systems")
    return both.withColumn("bytes", 100 * keys + 50 * F.col("entries"))
