"""Rows of ordinary tables as deltas, so that the engine's queries run over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pointers import make
from ..model import COLUMNS, NEGATED_BY, NEGATES
from .log import DeltaLog

DAY = 86_400_000
#: Derived retractions: name, (modulus, remainder) of the event's number, what they retract, delay in ms.
FAMILIES = (("neg1", (5, 1), "evt", DAY), ("negb", (15, 1), "evt", DAY * 3 // 2), ("neg2", (10, 1), "neg1", 2 * DAY), ("neg3", (20, 1), "neg2", 3 * DAY))
SEQ_STEP = 1_000_000_000


def millis(column: str) -> Column:
    """Whole milliseconds since 1970 of a time without a zone, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ)) div 1000")


def delta(id: Column, timestamp: Column, author: Column, system: Column, seq: Column, *pointers: Column) -> Column:
    return F.struct(id.alias("id"), timestamp.cast("long").alias("timestamp"), author.alias("author"), system.alias("system"), seq.cast("long").alias("seq"), F.array(*pointers).alias("pointers"))


def named(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def events(spark: SparkSession, sf_dir: str, retractions: bool = True) -> DeltaLog:
    """A delta for each event, and the retractions derived from them; one scan makes both."""
    n = F.col("event_id")
    author, system = named("agent_", n % 7), named("node_", n % 3)
    time, props = F.col("ms"), F.get_json_object("props", "$.k").cast("double")
    event = delta(
        named("evt/", n), time, author, system, n,
        make("subject", ref_id=named("user/", F.col("user_id")), context=F.col("event_type")), make("value", number=F.col("value"), pos=1), make("k", number=props, pos=2),
    )
    made = [event]
    for i, (name, (modulus, rest), target, delay) in enumerate(FAMILIES if retractions else ()):
        row = delta(named(f"{name}/", n), time + delay, author, system, n + (i + 1) * SEQ_STEP, make(NEGATES, ref_id=named(f"{target}/", n), context=NEGATED_BY))
        made.append(F.when(n % modulus == rest, row))
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", millis("ts"))
    return DeltaLog(source.select(F.inline(F.filter(F.array(*made), lambda d: d.isNotNull()))).select(*COLUMNS))


#: Attributes by table: key column, id prefix, columns, time column.
ATTRIBUTES = {
    "region": ("r_regionkey", ("r_name",), None),
    "nation": ("n_nationkey", ("n_name",), None),
    "customer": ("c_custkey", ("c_name", "c_acctbal", "c_mktsegment"), None),
    "supplier": ("s_suppkey", ("s_name", "s_acctbal"), None),
    "part": ("p_partkey", ("p_name", "p_brand", "p_retailprice"), None),
    "orders": ("o_orderkey", ("o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderdate"),
}
#: Links by name: table, key, foreign key, linked table, role of the linked object, property under which the link shows there.
LINKS = {
    "orders": ("o_orderkey", "o_custkey", "customer", "customer", "orders"),
    "customer": ("c_custkey", "c_nationkey", "nation", "nation", "customers"),
    "nation": ("n_nationkey", "n_regionkey", "region", "region", "nations"),
    "supplier": ("s_suppkey", "s_nationkey", "nation", "nation", "suppliers"),
}


def relational(spark: SparkSession, sf_dir: str, *tables: str) -> DeltaLog:
    """A delta for each attribute and each link of the tables' rows, and no others."""
    out: DataFrame | None = None
    for t, table in enumerate(tables):
        key, columns, when = ATTRIBUTES[table]
        source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        types = dict(source.dtypes)
        k = F.col(key)
        time = millis(when) if when else F.lit(1)
        author, system = named("agent_", k % 5), named("node_", k % 3)
        made = []
        for c in columns:
            own = {"text": F.col(c)} if types[c] == "string" else {"number": F.col(c)}
            made.append((c, make("entity", ref_id=named(f"{table}/", k), context=c), make(c, pos=1, **own)))
        if table in LINKS:
            _, foreign, other, role, inverse = LINKS[table]
            made.append((role, make("child", ref_id=named(f"{table}/", k), context=role), make(role, ref_id=named(f"{other}/", F.col(foreign)), context=inverse, pos=1)))
        rows = [delta(F.concat(F.lit(f"{table}/"), k.cast("string"), F.lit(f"/{name}")), time, author, system, k * 100 + i + t * SEQ_STEP, *ps) for i, (name, *ps) in enumerate(made)]
        part = source.select(F.inline(F.array(*rows))).select(*COLUMNS)
        out = part if out is None else out.unionAll(part)
    return DeltaLog(out)
