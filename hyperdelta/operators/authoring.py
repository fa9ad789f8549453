"""Making deltas: single ones on the driver, and many from tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pointers import make
from ..model import COLUMNS, NEGATED_BY, NEGATES, REASON, Target, delta, ref
from ..sources.log import DeltaLog
from .negation import live


def create(author: str, system: str, pointers: Iterable[tuple[str, Target]], id: str | None = None, timestamp: int | None = None) -> tuple:
    """A delta row, not yet persisted."""
    return delta(id or str(uuid.uuid4()), timestamp or int(time.time() * 1000), author, system, pointers)


def negate(author: str, system: str, target_id: str, reason: str | None = None, **more) -> tuple:
    """A retraction; an empty reason is left out."""
    return create(author, system, [(NEGATES, ref(target_id, NEGATED_BY)), *([(REASON, reason)] if reason else [])], **more)


def negations_of(ids: DataFrame, author: str, system: str, timestamp: Column, reason: str | None = None, seq: Column | None = None) -> DataFrame:
    """A retraction of each id (column id); its own id is derived from the target's, so doing it again makes the same."""
    pointers = [make(NEGATES, ref_id=F.col("id"), context=NEGATED_BY), *([make(REASON, text=F.lit(reason), pos=1)] if reason else [])]
    order = seq if seq is not None else F.monotonically_increasing_id()
    return ids.select(
        F.concat(F.lit("neg/"), "id").alias("id"), timestamp.cast("long").alias("timestamp"), F.lit(author).alias("author"), F.lit(system).alias("system"),
        order.cast("long").alias("seq"), F.array(*pointers).alias("pointers"),
    )


def objects_from(table: DataFrame, object_id: Column, columns: list[str], author: Column, system: Column, timestamp: Column, seq: Column, role: str = "entity") -> DataFrame:
    """One delta for each row and column with a value: the object under the column's name, and the value in a role of that name."""
    kinds = dict(table.dtypes)
    made = []
    for i, c in enumerate(columns):
        own = {"text": F.col(c)} if kinds[c] == "string" else {"truth": F.col(c)} if kinds[c] == "boolean" else {"number": F.col(c)}
        name = c.removeprefix("_")
        d = F.struct(
            F.concat(object_id, F.lit(f"/{name}")).alias("id"), timestamp.cast("long").alias("timestamp"), author.alias("author"), system.alias("system"),
            (seq * len(columns) + i).cast("long").alias("seq"), F.array(make(role, ref_id=object_id, context=c), make(name, pos=1, **own)).alias("pointers"),
        )
        made.append(F.when(F.col(c).isNotNull(), d))
    return table.select(F.inline(F.filter(F.array(*made), lambda d: d.isNotNull()))).select(*COLUMNS)


def relationships_from(table: DataFrame, id: Column, one: tuple[str, Column, str], other: tuple[str, Column, str], author: Column, system: Column, timestamp: Column, seq: Column) -> DataFrame:
    """One delta a row with two references (role, id, property): it shows on both objects."""
    ends = [make(role, ref_id=target, context=property, pos=i) for i, (role, target, property) in enumerate((one, other))]
    return table.select(id.alias("id"), timestamp.cast("long").alias("timestamp"), author.alias("author"), system.alias("system"), seq.cast("long").alias("seq"), F.array(*ends).alias("pointers"))


def upsert(log: DeltaLog, changes: DataFrame, author: str, system: str, timestamp: int, strict: bool = False) -> DataFrame:
    """Deltas that overwrite properties: retractions of what is live under them, and new deltas. changes: (object_id, property, value),
    the value a string, a boolean, a number, or a struct (str, num, bool) of which one is set; without any, nothing new is written.

    strict: only deltas whose pointer has the property's name as its role too are retracted.
    """
    refs = live(log).references.where("property IS NOT NULL")
    if strict:
        refs = refs.where(F.exists("pointers", lambda p: (p["ref_id"] == F.col("object_id")) & (p["ref_context"] == F.col("property")) & (p["role"] == F.col("property"))))
    old = refs.join(changes.select("object_id", "property").distinct(), ["object_id", "property"], "left_semi").select("id").distinct()
    gone = negations_of(old, author, system, F.lit(timestamp))
    role = F.regexp_replace("property", "^_", "")
    kind = dict(changes.dtypes)["value"]
    if kind.startswith("struct"):
        made = [make(role, pos=1, text=F.col("value.str")), make(role, pos=1, number=F.col("value.num")), make(role, pos=1, truth=F.col("value.bool"))]
        own = F.when(F.col("value.str").isNotNull(), made[0]).when(F.col("value.num").isNotNull(), made[1]).otherwise(made[2])
        some = F.coalesce(F.col("value.str"), F.col("value.num").cast("string"), F.col("value.bool").cast("string")).isNotNull()
    else:
        own = make(role, pos=1, **({"text": F.col("value")} if kind == "string" else {"truth": F.col("value")} if kind == "boolean" else {"number": F.col("value")}))
        some = F.col("value").isNotNull()
    new = changes.where(some).select(
        F.concat_ws("/", F.lit("set"), "object_id", "property", F.lit(timestamp)).alias("id"), F.lit(timestamp).cast("long").alias("timestamp"), F.lit(author).alias("author"),
        F.lit(system).alias("system"), F.monotonically_increasing_id().alias("seq"), F.array(make(role, ref_id=F.col("object_id"), context=F.col("property")), own).alias("pointers"),
    )
    return gone.unionByName(new)
