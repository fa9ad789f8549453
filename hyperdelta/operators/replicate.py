"""Merging logs: who is trusted, what is sent, in which batches, and the union that does not depend on order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..model import COLUMNS
from ..sources.log import DeltaLog, Store
from .filters import DeltaFilter


@dataclass(frozen=True)
class Trust:
    """Authors and systems that are trusted (None or empty: all), and a further condition in SQL."""

    authors: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()
    condition: str | None = None

    def column(self) -> Column:
        tests = [F.lit(True)]
        if self.authors:
            tests.append(F.col("author").isin(list(self.authors)))
        if self.systems:
            tests.append(F.col("system").isin(list(self.systems)))
        if self.condition:
            tests.append(F.expr(self.condition))
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


PERMISSIVE = Trust()


def combined(*policies: Trust) -> Column:
    """All must hold; so one side's policy narrows the other's and never widens it."""
    return reduce(lambda a, b: a & b, (p.column() for p in policies), F.lit(True))


def verified(deltas: DataFrame, *policies: Trust) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)"""
    ok = combined(*policies)
    return deltas.where(ok), deltas.where(~ok)


def sync_set(log: DeltaLog, where: DeltaFilter | None = None, since: int | None = None) -> DataFrame:
    """What a replica is sent first: deltas by the filter, from a time on. Retractions are sent, not applied."""
    rows = log.deltas if where is None else log.deltas.where(where.condition())
    return rows if since is None else rows.where(F.col("timestamp") >= since)


def batches(rows: DataFrame, size: int = 100) -> DataFrame:
    """The rows with batch_number, from 1 in the order of (timestamp, seq), and is_last.

    Rows are dealt by ranges of time and numbered range by range, so that no task sees all.
    """
    ranged = cut(rows.repartitionByRange("timestamp", "seq").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"), F.sum("count").over(every).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("timestamp", "seq")) + F.col("_base")
    number = F.floor((F.col("_n") - 1) / size) + 1
    out = ranged.join(bases, "_part").withColumn("_n", place).withColumn("batch_number", number)
    return out.withColumn("is_last", F.col("batch_number") == F.floor((F.col("_all") - 1) / size) + 1).drop("_part", "_base", "_all", "_n")


def merge(*logs: DeltaLog) -> DeltaLog:
    """The union of logs, one delta an id: in any order, any number of times, the same deltas."""
    return DeltaLog(reduce(lambda a, b: a.unionByName(b), (x.deltas.select(*COLUMNS) for x in logs))).deduplicated()


def missing(source: DeltaLog, replica: DeltaLog, *policies: Trust) -> DataFrame:
    """The source's trusted deltas that the replica lacks."""
    return source.deltas.where(combined(*policies)).join(replica.deltas.select("id"), "id", "left_anti")


def outgoing(deltas: DataFrame, mode: str, to_system: str, where: DeltaFilter | None = None, *policies: Trust) -> DataFrame:
    """What a link sends of new deltas: nothing in mode 'pull'; never what came from the other side; only what filter and trust let through."""
    if mode not in ("push", "pull", "bidirectional"):
        raise ValueError(f"mode {mode!r}")
    if mode == "pull":
        return deltas.limit(0)
    rows = deltas.where((F.col("system") != to_system) & combined(*policies))
    return rows if where is None else rows.where(where.condition())


def link_stats(deltas: DataFrame, *policies: Trust, by: str = "system") -> DataFrame:
    """(by, received, accepted, rejected) of arrivals."""
    ok = combined(*policies)
    return deltas.groupBy(by).agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@dataclass
class Link:
    """One store's side of an exchange with another. mode: 'push' sends, 'pull' fetches, 'bidirectional' does both. trust judges what
    comes in, filters what goes out and what comes in alike. A link is open until close()."""

    here: Store
    there: Store
    here_system: str
    there_system: str
    mode: str = "bidirectional"
    trust: tuple[Trust, ...] = (PERMISSIVE,)
    where: DeltaFilter | None = None
    is_open: bool = True

    def close(self) -> None:
        self.is_open = False

    def sync(self) -> dict[str, int]:
        """One exchange; how many deltas were sent, received and rejected. Doing it again changes nothing."""
        if not self.is_open:
            raise RuntimeError("the link is closed")
        if self.mode not in ("push", "pull", "bidirectional"):
            raise ValueError(f"mode {self.mode!r}")
        nothing = {"sent": 0, "rejected": 0}
        pulled = replicate(self.there, self.here, *self.trust, where=self.where, to_system=self.here_system) if self.mode != "push" else nothing
        pushed = replicate(self.here, self.there, where=self.where, to_system=self.there_system) if self.mode != "pull" else nothing
        return {"sent": pushed["sent"], "received": pulled["sent"], "rejected": pulled["rejected"]}


def replicate(source: Store, target: Store, *policies: Trust, where: DeltaFilter | None = None, to_system: str | None = None, audit: str | None = None) -> dict[str, Any]:
    """Appends to the target what it lacks of the source's deltas that the filter lets through and all policies trust; not what the
    target's own system made. Retractions go along as deltas. Gives the counts, and adds them as a row to the table at `audit`."""
    rows = sync_set(source.log(), where)
    if to_system is not None:
        rows = rows.where(F.col("system") != to_system)
    lacking = cut(rows.join(target.read().select("id"), "id", "left_anti").select(*COLUMNS).withColumn("_ok", combined(*policies)))
    n = lacking.agg(F.count_if("_ok").alias("sent"), F.count_if(~F.col("_ok")).alias("rejected"), F.max("timestamp").alias("latest")).first().asDict()
    if n["sent"]:
        target.append(lacking.where("_ok").drop("_ok"))
    if audit is not None:
        spark = lacking.sparkSession
        row = spark.createDataFrame([(source.path, target.path, n["sent"], n["rejected"], n["latest"])], "source string, target string, sent long, rejected long, latest long")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(audit)
    return n


class Links:
    """Links by name: opened, closed, run together."""

    def __init__(self) -> None:
        self._all: dict[str, Link] = {}

    def open(self, name: str, link: Link) -> Link:
        if name in self._all and self._all[name].is_open:
            raise ValueError(f"{name!r} is open")
        self._all[name] = link
        return link

    def close(self, name: str) -> None:
        self._all[name].close()

    def names(self) -> list[str]:
        return sorted(n for n, link in self._all.items() if link.is_open)

    def sync(self) -> dict[str, dict[str, int]]:
        """One exchange of each open link, by name."""
        return {name: self._all[name].sync() for name in self.names()}
