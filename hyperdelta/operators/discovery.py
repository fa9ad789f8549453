"""Fields and types found from the data, and projections of object views onto fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pointers as P
from ..plans.schema import HyperSchema
from ..sources.log import DeltaLog
from .hyperview import Roots, long_form
from .negation import live


def input_types(log: DeltaLog, sample: int = 100) -> DataFrame:
    """(role, type): Int, Float, Boolean or String, by each role's first primitive in the first `sample` live deltas that hold one.

    The limit is the feature: a look at the head of the log.
    """
    some = live(log).deltas.where(F.exists("pointers", lambda p: p["kind"] != "ref")).orderBy("seq").limit(sample)
    flat = some.select("seq", F.inline("pointers")).where("kind <> 'ref'")
    first = F.min_by(F.struct("kind", "num"), F.struct("seq", "pos")).alias("f")
    kind = F.when(F.col("f.kind") == "bool", "Boolean").when(F.col("f.kind") == "str", "String").when(F.col("f.num") == F.floor("f.num"), "Int").otherwise("Float")
    return flat.groupBy("role").agg(first).select("role", kind.alias("type"))


def first_values(log: DeltaLog, roots: Roots, property: str, role: str, type: str | None = None) -> DataFrame:
    """(object_id, value): of each object's first delta under the property, its first primitive in the role; null if it is not of the type."""
    primitives = F.filter("pointers", lambda p: (p["role"] == role) & (p["kind"] != "ref"))
    rows = long_form(log, roots).where(F.col("property") == property)
    first = rows.groupBy("object_id").agg(F.min_by(F.get(primitives, F.lit(0)), F.col("seq")).alias("p"))
    value: Column = P.value(F.col("p"))
    return first.select("object_id", (F.when(P.primitive_test(type, F.col("p")), value) if type else value).alias("value"))


def reference_lists(log: DeltaLog, roots: Roots, property: str, role: str) -> DataFrame:
    """(object_id, refs): of each delta under the property its first reference in the role, in order of arrival."""
    refs = F.filter("pointers", lambda p: (p["role"] == role) & (p["kind"] == "ref"))
    rows = long_form(log, roots).where(F.col("property") == property).select("object_id", "seq", F.get(refs, F.lit(0))["ref_id"].alias("r")).where("r IS NOT NULL")
    return rows.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("seq", "r"))).alias("l")).select("object_id", F.col("l.r").alias("refs"))


def select(log: DeltaLog, schema: HyperSchema, roots: Roots, fields: list[str]) -> DataFrame:
    """(object_id, one column a field): primitive rules give first values, other rules lists of references."""
    out: DataFrame | None = None
    for name in fields:
        rule = schema.rules[name]
        part = first_values(log, roots, name, name, rule.schema) if rule.primitive else reference_lists(log, roots, name, name)
        part = part.withColumnRenamed(part.columns[1], name)
        out = part if out is None else out.join(part, "object_id", "full")
    return out
