"""The log's row: an immutable, attributed assertion (a delta) whose pointers are references or primitives.

A delta is (id, timestamp in ms, author, system, seq, pointers). seq is the order of arrival and breaks ties between equal
timestamps. A pointer is a struct that is tagged by kind: 'ref' (ref_id, and ref_context, the property under which the delta
shows on the target), 'str', 'num' or 'bool'; exactly one value is set. A tagged struct, unlike a variant, can be grouped by.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ref_id", T.StringType()),
        T.StructField("ref_context", T.StringType()),
        T.StructField("str", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("bool", T.BooleanType()),
    ]
)
DELTA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("pointers", T.ArrayType(POINTER)),
    ]
)
COLUMNS = DELTA.names
NEGATES, NEGATED_BY, REASON = "negates", "negated_by", "reason"

Target = dict | str | int | float | bool


def ref(target: str, context: str | None = None) -> dict[str, str]:
    return {"id": target} if context is None else {"id": target, "context": context}


def pointer(role: str, target: Target, pos: int = 0) -> tuple:
    """A pointer row from a role and a reference (as made by ref) or a primitive."""
    if isinstance(target, dict):
        return pos, role, "ref", target["id"], target.get("context"), None, None, None
    if isinstance(target, bool):
        return pos, role, "bool", None, None, None, None, target
    if isinstance(target, (int, float)):
        return pos, role, "num", None, None, None, float(target), None
    if isinstance(target, str):
        return pos, role, "str", None, None, target, None, None
    raise TypeError(f"a target is a reference, a string, a number or a boolean, not {type(target).__name__}")


def delta(id: str, timestamp: int, author: str, system: str, pointers: Iterable[tuple[str, Target]], seq: int | None = None) -> tuple:
    """A delta row from (role, target) pairs."""
    return id, timestamp, author, system, seq, [pointer(role, target, i) for i, (role, target) in enumerate(pointers)]


def frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Delta rows as a DataFrame; rows without a seq get their place."""
    rows = [(*r[:4], i if r[4] is None else r[4], r[5]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, DELTA)


def as_json(row: Any) -> dict[str, Any]:
    """A collected delta row as plain data, targets as they came in."""

    def target(p: Any) -> Any:
        if p["kind"] == "ref":
            return ref(p["ref_id"], p["ref_context"])
        value = p[p["kind"]]
        return int(value) if p["kind"] == "num" and value == int(value) else value

    pointers = [{"role": p["role"], "target": target(p)} for p in sorted(row["pointers"], key=lambda p: p["pos"])]
    return {"id": row["id"], "timestamp": row["timestamp"], "author": row["author"], "system": row["system"], "pointers": pointers}
