"""Object views resolved to plain rows: for each property a source, a value from a delta, and a strategy for many deltas.

All properties of all objects resolve in one aggregation, so one exchange, however many properties; only consensus first
counts equal deltas.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pointers import sum_and_count

#: A strategy makes an aggregate of the value, over the rows where the condition holds.
Strategy = Callable[[Column, Column], Column]


def most_recent(value: Column, when: Column) -> Column:
    """Of the latest delta; of equal times the first to arrive."""
    return F.max_by(value, F.when(when, F.struct(F.col("timestamp"), -F.col("seq"))))


def first_write(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.struct("timestamp", "seq")))


def all_values(value: Column, when: Column) -> Column:
    """The values of all deltas, in order of arrival; those without a value are left out."""
    pairs = F.array_sort(F.collect_list(F.when(when & value.isNotNull(), F.struct(F.col("seq").alias("seq"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def _trusted(column: str, order: list[str]) -> Strategy:
    def strategy(value: Column, when: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col(column)) if order else F.lit(0)
        rank = F.when(place > 0, place).otherwise(len(order) + 1)
        # of a trusted source its first delta; without any the most recent
        return F.min_by(value, F.when(when, F.struct(rank.alias("r"), F.when(place > 0, F.col("seq")).otherwise(-F.col("timestamp")).alias("t"), F.col("seq"))))

    return strategy


def trusted_author(order: list[str]) -> Strategy:
    """Of the first author of the list who has a delta, the first of theirs; else the most recent of all."""
    return _trusted("author", order)


def trusted_system(order: list[str]) -> Strategy:
    return _trusted("system", order)


def _numbers(part: int, role: str | None) -> Column:
    return sum_and_count(role=role)[part]


def average(role: str | None = None) -> Strategy:
    """The mean of every numeric pointer of every delta, or of those with a role; the value is not asked for."""
    return lambda value, when: F.sum(F.when(when, _numbers(0, role))) / F.nullif(F.sum(F.when(when, _numbers(1, role))), F.lit(0))


def minimum(role: str | None = None) -> Strategy:
    return lambda value, when: F.min(F.when(when, _numbers(2, role)))


def maximum(role: str | None = None) -> Strategy:
    return lambda value, when: F.max(F.when(when, _numbers(3, role)))


def consensus(value: Column, when: Column) -> Column:
    """Of the delta whose pointers occur most often, the first seen of equals. resolve() counts them beforehand."""
    return F.max_by(value, F.when(when, F.struct(F.col("_count"), -F.col("_seq"))))


def custom(aggregate: Callable[[Column], Column]) -> Strategy:
    """Any aggregate of the values."""
    return lambda value, when: aggregate(F.when(when, value))


@dataclass(frozen=True)
class Property:
    source: str
    value: Column
    strategy: Strategy = most_recent


@dataclass(frozen=True)
class ViewSchema:
    properties: dict[str, Property] = field(default_factory=dict)


def simple(values: dict[str, Column], strategy: Strategy = most_recent) -> ViewSchema:
    """Each property from the source of its own name."""
    return ViewSchema({name: Property(name, value, strategy) for name, value in values.items()})


def _counted(long: DataFrame, by: list[str]) -> DataFrame:
    """One row for each different content under a property: how often it occurs, first when, and its first delta's columns."""
    same = F.to_json("pointers")
    first = F.min_by(F.struct("id", "timestamp", "author", "system", "seq", "pointers"), F.col("seq"))
    rows = long.groupBy(*by, same.alias("_same")).agg(F.count(F.lit(1)).alias("_count"), F.min("seq").alias("_seq"), first.alias("_d"))
    return rows.select(*by, "_count", "_seq", "_d.*")


def resolve(long: DataFrame, schema: ViewSchema) -> DataFrame:
    """(object_id, one column a property) of every object of the long form that has any of the properties' sources.

    A property without a delta is null.
    """
    plain = {n: p for n, p in schema.properties.items() if p.strategy is not consensus}
    voted = {n: p for n, p in schema.properties.items() if p.strategy is consensus}

    def aggregated(rows: DataFrame, properties: dict[str, Property]) -> DataFrame:
        rows = rows.where(F.col("property").isin(sorted({p.source for p in properties.values()})))
        return rows.groupBy("object_id").agg(*(p.strategy(p.value, F.col("property") == p.source).alias(n) for n, p in properties.items()))

    parts = [aggregated(long, plain)] if plain else []
    if voted:
        parts.append(aggregated(_counted(long, ["object_id", "property"]), voted))
    out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "object_id", "full")
    return out.select("object_id", *schema.properties)


def resolve_each(long: DataFrame, value: Column, strategy: Strategy = most_recent) -> DataFrame:
    """(object_id, property, value): every property by the same value and strategy."""
    rows = _counted(long, ["object_id", "property"]) if strategy is consensus else long
    return rows.groupBy("object_id", "property").agg(strategy(value, F.lit(True)).alias("value"))


def resolve_nested(parent: DataFrame, link: str, child: DataFrame, prefix: str) -> DataFrame:
    """A resolved view with the resolved view of the object that its column `link` names, columns prefixed.

    Levels are resolved by their own schemas first and joined after, so what a level needs is built once.
    """
    renamed = child.select(F.col("object_id").alias(link), *(F.col(c).alias(f"{prefix}{c}") for c in child.columns if c != "object_id"))
    return parent.join(renamed, link, "left")
