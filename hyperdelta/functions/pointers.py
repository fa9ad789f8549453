"""Columns over a delta's pointers. All take the name of the pointers column, and stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def make(role: Column | str, *, ref_id: Column | None = None, context: Column | str | None = None, text: Column | None = None, number: Column | None = None, truth: Column | None = None, pos: int = 0) -> Column:
    """A pointer struct; exactly one of ref_id, text, number and truth is given."""
    given = {"ref": ref_id, "str": text, "num": number, "bool": truth}
    (kind,) = [k for k, v in given.items() if v is not None]
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    null = lambda k: F.lit(None).cast(k)
    return F.struct(
        F.lit(pos).alias("pos"),
        lit(role).cast("string").alias("role"),
        F.lit(kind).alias("kind"),
        (ref_id if ref_id is not None else null("string")).cast("string").alias("ref_id"),
        lit(context).cast("string").alias("ref_context"),
        (text if text is not None else null("string")).cast("string").alias("str"),
        (number if number is not None else null("double")).cast("double").alias("num"),
        (truth if truth is not None else null("boolean")).cast("boolean").alias("bool"),
    )


def value(p: Column) -> Column:
    """A pointer's target as text: a reference's id, or the primitive."""
    number = F.when(p["num"] == F.floor(p["num"]), F.when(F.abs(p["num"]) < 1e15, F.floor(p["num"]).cast("string"))).otherwise(p["num"].cast("string"))
    return F.coalesce(p["ref_id"], p["str"], number, p["num"].cast("string"), p["bool"].cast("string"))


def first(role: str, pointers: str = "pointers") -> Column:
    """The first pointer with a role; null without one."""
    return F.get(F.filter(F.col(pointers), lambda p: p["role"] == role), F.lit(0))


def primitive(role: str, pointers: str = "pointers") -> Column:
    """The first pointer with the role, its target as text."""
    return value(first(role, pointers))


def number(role: str, pointers: str = "pointers") -> Column:
    return first(role, pointers)["num"]


def reference(role: str, pointers: str = "pointers") -> Column:
    """The id that the first pointer with the role refers to; null if it is a primitive."""
    return first(role, pointers)["ref_id"]


def every(role: str, pointers: str = "pointers") -> Column:
    """All targets of pointers with the role, as text, in order."""
    return F.transform(F.filter(F.col(pointers), lambda p: p["role"] == role), value)


def any_reference(*, ids: list[str] | None = None, contexts: list[str] | None = None, pointers: str = "pointers") -> Column:
    """Whether some pointer refers to one of the ids, or under one of the contexts; an empty list matches nothing."""

    def hit(p: Column) -> Column:
        tests = [p[c].isin(v) if v else F.lit(False) for c, v in (("ref_id", ids), ("ref_context", contexts)) if v is not None]
        return reduce(lambda a, b: a & b, tests, p["kind"] == "ref")

    return F.exists(F.col(pointers), lambda p: F.coalesce(hit(p), F.lit(False)))


def sum_and_count(pointers: str = "pointers", role: str | None = None) -> tuple[Column, Column, Column, Column]:
    """Of a delta's numeric pointers (with a role, if given): sum, count, least, greatest."""
    kept = F.transform(F.filter(F.col(pointers), lambda p: (p["kind"] == "num") & (F.lit(True) if role is None else p["role"] == role)), lambda p: p["num"])
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept), F.array_min(kept), F.array_max(kept)


def is_reference(p: Column) -> Column:
    """A reference with a non-empty id; its context may be missing but not empty."""
    ok = (p["kind"] == "ref") & (F.length(p["ref_id"]) > 0) & (p["ref_context"].isNull() | (F.length(p["ref_context"]) > 0))
    return F.coalesce(ok, F.lit(False))


def is_domain_node(p: Column) -> Column:
    """A reference with a non-empty id, whatever its context."""
    return F.coalesce((p["kind"] == "ref") & (F.length(p["ref_id"]) > 0), F.lit(False))


def is_primitive(p: Column) -> Column:
    set_ = F.when(p["kind"] == "str", p["str"].isNotNull()).when(p["kind"] == "num", p["num"].isNotNull()).when(p["kind"] == "bool", p["bool"].isNotNull())
    return F.coalesce(set_, F.lit(False))


def _integer(p: Column) -> Column:
    return (p["kind"] == "num") & (p["num"] == F.floor(p["num"]))


#: Primitive types by name, as tests of a pointer; unknown names are refused by primitive_test.
PRIMITIVES = {
    "string": lambda p: p["kind"] == "str",
    "string.email": lambda p: (p["kind"] == "str") & p["str"].rlike(EMAIL),
    "integer": _integer,
    "integer.year": lambda p: _integer(p) & p["num"].between(1800, 2100),
    "boolean": lambda p: p["kind"] == "bool",
}


def primitive_test(name: str, p: Column) -> Column:
    return F.coalesce(PRIMITIVES[name](p), F.lit(False))


def error(pointers: str = "pointers") -> Column:
    """The first rule that a delta breaks, as text; null for a valid one.

    Timestamps are finite, whole and positive; id, author and system are not empty; pointers may be none but are each valid:
    a non-empty role, and a reference or a primitive as target.
    """

    def empty(name: str) -> Column:
        return F.coalesce(F.length(F.col(name)), F.lit(0)) == 0

    def wrong(p: Column) -> Column:
        return F.coalesce(F.length(p["role"]), F.lit(0)).__eq__(0) | ~(is_domain_node(p) | is_primitive(p))

    bad = F.filter(F.transform(F.col(pointers), lambda p, i: F.when(wrong(p), F.concat(F.lit("Invalid pointer at index "), i.cast("string"), F.when(F.coalesce(F.length(p["role"]), F.lit(0)) == 0, ": role must be a non-empty string").otherwise(": target must be a reference or a primitive")))), lambda x: x.isNotNull())
    return (
        F.when(empty("id"), "id must be a non-empty string")
        .when(F.coalesce(F.col("timestamp"), F.lit(0)) <= 0, "timestamp must be a positive number")
        .when(empty("author"), "author must be a non-empty string")
        .when(empty("system"), "system must be a non-empty string")
        .when(F.col(pointers).isNull(), "pointers must be an array")
        .otherwise(F.get(bad, F.lit(0)))
    )
