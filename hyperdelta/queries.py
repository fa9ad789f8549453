"""The engine's queries over the test tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import service
from .checkpoints import cut, shared_folder
from .functions import pointers as P
from .model import COLUMNS, delta, frame, ref
from .operators import authoring, discovery, filters, hyperview, materialize, negation, replicate, timetravel, view
from .operators.filters import DeltaFilter
from .operators.replicate import Trust
from .plans import schemadata
from .plans.schema import HyperSchema, Registry, Rule, Versions
from .sources import bridge
from .sources.log import DeltaLog, Store, bad_lines, from_feed, to_feed
from .streaming import subscribe as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the queries: two times in ms, and the bounds of a third range.
T1, T2, A, B = 1705276800000, 1705881600000, 1704672000000, 1705104000000
FOREVER = 9_000_000_000_000

EVENTS = """
evt AS (SELECT 'evt/' || event_id AS id, epoch_us(ts) // 1000 AS timestamp, 'agent_' || (event_id % 7) AS author, 'node_' || (event_id % 3) AS system,
  event_id AS seq, 'user/' || user_id AS object_id, event_type AS property, value, (props->>'k')::DOUBLE AS k, event_id FROM events),
neg AS (
  SELECT 'neg1/' || event_id AS negator, id AS target, timestamp + 86400000 AS nt, author, system, seq + 1000000000 AS seq FROM evt WHERE event_id % 5 = 1
  UNION ALL SELECT 'negb/' || event_id, id, timestamp + 129600000, author, system, seq + 2000000000 FROM evt WHERE event_id % 15 = 1
  UNION ALL SELECT 'neg2/' || event_id, 'neg1/' || event_id, timestamp + 172800000, author, system, seq + 3000000000 FROM evt WHERE event_id % 10 = 1
  UNION ALL SELECT 'neg3/' || event_id, 'neg2/' || event_id, timestamp + 259200000, author, system, seq + 4000000000 FROM evt WHERE event_id % 20 = 1),
dlog AS (SELECT id, timestamp, author, system, seq FROM evt UNION ALL SELECT negator, nt, author, system, seq FROM neg),
refs AS (SELECT id, timestamp, author, system, seq, object_id, property FROM evt UNION ALL SELECT negator, nt, author, system, seq, target, 'negated_by' FROM neg)"""


def gone(asof: int | None = None, s: str = "", only: str = "TRUE") -> str:
    """CTEs that end in gone: what is effectively retracted at a time."""
    return f"""n{s} AS (SELECT * FROM neg WHERE nt <= {asof or FOREVER} AND {only}),
x3{s} AS (SELECT DISTINCT target FROM n{s} WHERE negator LIKE 'neg3/%'),
x2{s} AS (SELECT DISTINCT target FROM n{s} WHERE negator LIKE 'neg2/%' AND negator NOT IN (SELECT target FROM x3{s})),
x1{s} AS (SELECT DISTINCT target FROM n{s} WHERE (negator LIKE 'neg1/%' OR negator LIKE 'negb/%') AND negator NOT IN (SELECT target FROM x2{s})),
gone{s} AS (SELECT target FROM x1{s} UNION SELECT target FROM x2{s} UNION SELECT target FROM x3{s})"""


#: CTEs, with live: the live deltas, and shown: live references with a property.
LIVE = f"""WITH {EVENTS}, {gone()},
live AS (SELECT * FROM dlog WHERE id NOT IN (SELECT target FROM gone)),
shown AS (SELECT * FROM refs WHERE id NOT IN (SELECT target FROM gone)),
mine AS (SELECT shown.*, evt.value, evt.k FROM shown JOIN evt USING (id))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DeltaLog:
    return bridge.events(spark, sf_dir)


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of users."""
    return hyperview.long_form(_log(spark, sf_dir)).where("property <> 'negated_by'")


def _listed(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


# Filters

IDS = [f"evt/{i}" for i in range(1, 60)] + [f"neg1/{i}" for i in range(1, 60, 5)]
TARGETS = ["user/1", "user/2", "user/3", "evt/6", "evt/16"]


@query(f"{LIVE} SELECT id, timestamp FROM live WHERE id IN ({_listed(IDS)})")
def filter_ids(spark, sf_dir):
    return filters.query(_log(spark, sf_dir), DeltaFilter(ids=IDS)).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM shown WHERE object_id IN ({_listed(TARGETS)})")
def filter_target_ids(spark, sf_dir):
    return filters.query(_log(spark, sf_dir), DeltaFilter(target_ids=TARGETS)).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM shown WHERE property IN ('purchase', 'negated_by')")
def filter_contexts(spark, sf_dir):
    return filters.query(_log(spark, sf_dir), DeltaFilter(target_contexts=["purchase", "negated_by"])).select("id", "timestamp")


@query("SELECT 'orders/' || o_orderkey || '/customer' AS id, epoch_us(o_orderdate) // 1000 AS timestamp FROM orders WHERE o_custkey BETWEEN 1 AND 20")
def filter_target_and_context_cross(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "orders")
    wanted = DeltaFilter(target_ids=[f"customer/{i}" for i in range(1, 21)], target_contexts=["customer"])
    return filters.query(log, wanted).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM live WHERE author IN ('agent_1', 'agent_4')")
def filter_authors(spark, sf_dir):
    return filters.query(_log(spark, sf_dir), DeltaFilter(authors=["agent_1", "agent_4"])).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM live WHERE system = 'node_2'")
def filter_systems(spark, sf_dir):
    return filters.query(_log(spark, sf_dir), DeltaFilter(systems=["node_2"])).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM live WHERE timestamp BETWEEN {A} AND {B}")
def filter_ts_range(spark, sf_dir):
    return filters.query(_log(spark, sf_dir), DeltaFilter(start=A, end=B)).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM mine WHERE value > 100 AND k < 50")
def filter_predicate(spark, sf_dir):
    test = (P.number("value") > 100) & (P.number("k") < 50)
    return filters.query(_log(spark, sf_dir), DeltaFilter(predicate=test)).select("id", "timestamp")


@query(f"{LIVE} SELECT id, timestamp FROM shown WHERE property IN ('click', 'view') AND author <> 'agent_0' AND system = 'node_1' AND timestamp <= {B}")
def filter_combined(spark, sf_dir):
    wanted = DeltaFilter(target_contexts=["click", "view"], systems=["node_1"], end=B, predicate="author <> 'agent_0'")
    return filters.query(_log(spark, sf_dir), wanted).select("id", "timestamp")


@query("SELECT criterion, 0::BIGINT AS n FROM (VALUES ('authors'), ('ids'), ('systems'), ('target_contexts'), ('target_ids')) AS t(criterion)")
def filter_empty_list(spark, sf_dir):
    deltas, out = _log(spark, sf_dir).deltas, None
    counts = [F.count_if(DeltaFilter(**{c: []}).condition()).alias(c) for c in ("authors", "ids", "systems", "target_contexts", "target_ids")]
    out = deltas.agg(*counts)
    return out.unpivot([], out.columns, "criterion", "n")


@query(f"{LIVE} SELECT count(*)::BIGINT AS with_negated, (SELECT count(*) FROM live)::BIGINT AS without_negated FROM dlog")
def include_negated_flag(spark, sf_dir):
    m = negation.marked(_log(spark, sf_dir))
    return m.agg(F.count(F.lit(1)).alias("with_negated"), F.count_if(~F.col("negated")).alias("without_negated"))


@query(f"{LIVE} SELECT id, seq, (SELECT count(*) FROM live WHERE author = 'agent_3')::BIGINT AS total FROM live WHERE author = 'agent_3' ORDER BY seq LIMIT 25")
def limit_by_seq(spark, sf_dir):
    rows = filters.query(_log(spark, sf_dir), DeltaFilter(authors=["agent_3"]))
    return filters.first(rows.select("id", "seq"), 25).withColumn("total", F.lit(rows.count()).cast("long"))


@query(f"WITH {EVENTS}, w AS (SELECT unnest(['evt/9', 'evt/1', 'none', 'neg1/6']) AS id, unnest(range(4)) AS ord) SELECT id, ord::BIGINT AS ord, timestamp FROM w JOIN dlog USING (id)")
def get_deltas_ordered(spark, sf_dir):
    return filters.by_ids(_log(spark, sf_dir), ["evt/9", "evt/1", "none", "neg1/6"]).select("id", "ord", "timestamp")


@query(f"WITH {EVENTS} SELECT id, timestamp FROM dlog WHERE author = 'agent_2' AND (timestamp > {T1} OR (timestamp = {T1} AND id >= 'evt/5')) ORDER BY timestamp, id LIMIT 100")
def scan_keyset(spark, sf_dir):
    return filters.scan(_log(spark, sf_dir), DeltaFilter(authors=["agent_2"]), after=(T1, "evt/5")).select("id", "timestamp").limit(100)


@query(f"{LIVE}, a AS (SELECT DISTINCT id FROM refs WHERE property = 'click'), b AS (SELECT id FROM dlog WHERE system = 'node_0') SELECT id FROM a JOIN b USING (id)")
def index_intersection(spark, sf_dir):
    return filters.ids_matching(_log(spark, sf_dir), target_contexts=["click"], systems=["node_0"])


@query("""SELECT event_id AS seq, CASE event_id % 50 WHEN 0 THEN 'id must be a non-empty string' WHEN 10 THEN 'timestamp must be a positive number'
WHEN 20 THEN 'author must be a non-empty string' WHEN 30 THEN 'system must be a non-empty string' ELSE 'Invalid pointer at index 1: role must be a non-empty string' END AS error
FROM events WHERE event_id % 50 IN (0, 10, 20, 30, 40)""")
def validate_quarantine(spark, sf_dir):
    n = F.col("seq") % 50
    broken = bridge.events(spark, sf_dir, retractions=False).deltas.withColumns({
        "id": F.when(n == 0, "").otherwise(F.col("id")), "timestamp": F.when(n == 10, 0).otherwise(F.col("timestamp")),
        "author": F.when(n == 20, "").otherwise(F.col("author")), "system": F.when(n == 30, None).otherwise(F.col("system")),
        "pointers": F.when(n == 40, F.transform("pointers", lambda p, i: p.withField("role", F.when(i == 1, "").otherwise(p["role"])))).otherwise(F.col("pointers")),
    })
    return DeltaLog(broken).quarantine().select("seq", "error")


@query(f"""WITH {EVENTS}, c AS (SELECT (SELECT count(DISTINCT object_id) FROM refs) AS target_ids, (SELECT count(DISTINCT property) FROM refs) AS target_contexts,
(SELECT count(DISTINCT author) FROM dlog) AS authors, (SELECT count(DISTINCT system) FROM dlog) AS systems, (SELECT count(*) FROM dlog) AS entries)
SELECT *, 100 * (target_ids + target_contexts + authors + systems) + 50 * entries AS bytes FROM c""")
def index_cardinalities(spark, sf_dir):
    return filters.cardinalities(_log(spark, sf_dir))


# Retractions


@query(f"WITH {EVENTS}, {gone()} SELECT target AS id FROM gone")
def negated_full(spark, sf_dir):
    return negation.negated_ids(_log(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT DISTINCT target AS id FROM neg")
def negated_single_pass(spark, sf_dir):
    return negation.negated_ids(_log(spark, sf_dir), mode="single_pass")


@query(f"WITH {EVENTS}, {gone(T1)} SELECT target AS id FROM gone")
def negated_asof(spark, sf_dir):
    return negation.negated_ids(_log(spark, sf_dir), asof=T1)


@query(f"WITH {EVENTS}, {gone(only=chr(39) + 'agent_1' + chr(39) + ' = author')} SELECT target AS id FROM gone")
def negation_by_author(spark, sf_dir):
    return negation.negated_ids(_log(spark, sf_dir), authors=["agent_1"])


@query(f"""WITH {EVENTS}, {gone()}, b AS (SELECT target, arg_max(negator, row(nt, -seq)) AS negated_by, max(nt) AS negation_timestamp FROM neg
WHERE negator NOT IN (SELECT target FROM gone) GROUP BY target)
SELECT DISTINCT neg.target AS id, b.target IS NOT NULL AS negated, b.negated_by, b.negation_timestamp, b.target IS NULL AS was_restored, FALSE AS undetermined
FROM neg LEFT JOIN b ON b.target = neg.target""")
def negation_states(spark, sf_dir):
    return negation.states(_log(spark, sf_dir))


@query(f"WITH {EVENTS}, {gone(T1)} SELECT id, id IN (SELECT target FROM gone) AS negated FROM dlog WHERE timestamp <= {T1}")
def negation_marked(spark, sf_dir):
    return negation.marked(_log(spark, sf_dir), asof=T1).select("id", "negated")


# Object views


@query(f"{LIVE} SELECT object_id, property, id FROM shown")
def hv_long(spark, sf_dir):
    return hyperview.long_form(_log(spark, sf_dir)).select("object_id", "property", "id")


@query(f"{LIVE} SELECT object_id, property, count(*)::BIGINT AS n FROM shown GROUP BY ALL")
def hv_counts(spark, sf_dir):
    return hyperview.counts(hyperview.long_form(_log(spark, sf_dir)))


@query(f"WITH {EVENTS} SELECT object_id, property, count(*)::BIGINT AS n FROM refs WHERE id NOT IN (SELECT target FROM neg) GROUP BY ALL")
def hv_single_pass(spark, sf_dir):
    return hyperview.counts(hyperview.long_form(_log(spark, sf_dir), negation="single_pass"))


@query("SELECT 'user/' || user_id AS object_id, event_type AS property, 2 * count(*)::BIGINT AS n FROM events GROUP BY ALL")
def hv_duplicate_pointer(spark, sf_dir):
    deltas = bridge.events(spark, sf_dir, retractions=False).deltas
    twice = deltas.withColumn("pointers", F.concat("pointers", F.slice("pointers", 1, 1)))
    return hyperview.counts(hyperview.long_form(DeltaLog(twice)))


@query(f"{LIVE} SELECT object_id, CASE WHEN property = 'negated_by' THEN 'negates' ELSE 'subject' END AS property, count(*)::BIGINT AS n FROM shown GROUP BY ALL")
def hv_custom_selector(spark, sf_dir):
    return hyperview.counts(hyperview.long_form(_log(spark, sf_dir), selector="by_role"))


@query(f"{LIVE} SELECT object_id, '_default' AS property, count(*)::BIGINT AS n FROM shown GROUP BY ALL")
def hv_default_bucket(spark, sf_dir):
    return hyperview.counts(hyperview.long_form(_log(spark, sf_dir), selector="everything"))


@query(f"{LIVE} SELECT object_id, count(DISTINCT property)::BIGINT AS properties, count(*)::BIGINT AS deltas FROM shown GROUP BY ALL")
def hv_packed(spark, sf_dir):
    packed = hyperview.packed(hyperview.long_form(_log(spark, sf_dir)))
    deltas = F.aggregate(F.map_values("props"), F.lit(0), lambda a, x: a + F.size(x))
    return packed.select("object_id", F.size("props").cast("long").alias("properties"), deltas.cast("long").alias("deltas"))


# Strategies

_EACH = f"{LIVE} SELECT object_id, property, {{}} AS value FROM mine GROUP BY ALL"


@query(_EACH.format("arg_max(value, row(timestamp, -seq))"))
def view_most_recent(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), P.number("value"))


@query(_EACH.format("arg_min(value, row(timestamp, seq))"))
def view_first_write(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), P.number("value"), view.first_write)


@query(_EACH.format("string_agg(k::BIGINT::VARCHAR, ',' ORDER BY seq)"))
def view_all_values(spark, sf_dir):
    values = view.resolve_each(_views(spark, sf_dir), P.primitive("k"), view.all_values)
    return values.withColumn("value", F.array_join("value", ","))


def _trusted_sql(column: str, order: list[str]) -> str:
    rank = "CASE " + " ".join(f"WHEN {column} = '{x}' THEN {i}" for i, x in enumerate(order)) + f" ELSE {len(order)} END"
    return f"arg_min(value, row({rank}, CASE WHEN {rank} < {len(order)} THEN seq ELSE -timestamp END, seq))"


@query(_EACH.format(_trusted_sql("author", ["agent_5", "agent_2"])))
def view_trusted_author(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), P.number("value"), view.trusted_author(["agent_5", "agent_2"]))


@query(_EACH.format(_trusted_sql("system", ["node_2"])))
def view_trusted_system(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), P.number("value"), view.trusted_system(["node_2"]))


@query(f"""{LIVE}, c AS (SELECT object_id, property, floor(k / 10) AS bucket, count(*) AS n, min(seq) AS s FROM mine GROUP BY ALL)
SELECT object_id, property, arg_max(bucket, row(n, -s)) AS value FROM c GROUP BY ALL""")
def view_consensus(spark, sf_dir):
    bucket = F.transform(F.slice("pointers", 3, 1), lambda p: p.withField("num", F.floor(p["num"] / 10).cast("double")))
    return view.resolve_each(_views(spark, sf_dir).withColumn("pointers", bucket), P.number("k"), view.consensus)


@query(_EACH.format("round((sum(value) + sum(k)) / (count(value) + count(k)), 9)"))
def view_average(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), F.lit(None), view.average()).withColumn("value", F.round("value", 9))


@query(_EACH.format("min(least(value, k))"))
def view_minimum(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), F.lit(None), view.minimum())


@query(_EACH.format("max(value)"))
def view_maximum(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), F.lit(None), view.maximum("value"))


@query(f"""{LIVE} SELECT object_id, arg_max(value, row(timestamp, -seq)) FILTER (property = 'purchase') AS last_purchase,
arg_min(value, row(timestamp, seq)) FILTER (property = 'signup') AS first_signup, round(avg(value) FILTER (property = 'view'), 9) AS mean_view,
max(value) FILTER (property = 'error') AS worst_error, count(*) FILTER (property = 'click')::BIGINT AS clicks FROM mine GROUP BY ALL""")
def view_wide_multi(spark, sf_dir):
    value = P.number("value")
    schema = view.ViewSchema({
        "last_purchase": view.Property("purchase", value), "first_signup": view.Property("signup", value, view.first_write),
        "mean_view": view.Property("view", value, view.average("value")), "worst_error": view.Property("error", value, view.maximum("value")),
        "clicks": view.Property("click", value, view.custom(F.count)),
    })
    return view.resolve(_views(spark, sf_dir), schema).withColumn("mean_view", F.round("mean_view", 9))


@query(_EACH.format("round(median(value), 9)"))
def custom_strategy(spark, sf_dir):
    return view.resolve_each(_views(spark, sf_dir), P.number("value"), view.custom(F.median)).withColumn("value", F.round("value", 9))


@query(f"{LIVE} SELECT id, value, k FROM mine")
def extract_primitive(spark, sf_dir):
    return _views(spark, sf_dir).select("id", P.number("value").alias("value"), P.number("k").alias("k"))


@query(f"{LIVE} SELECT id, object_id AS subject FROM mine")
def extract_reference(spark, sf_dir):
    return _views(spark, sf_dir).select("id", P.reference("subject").alias("subject"))


@query("SELECT 'orders/' || o_orderkey AS object_id, 'orders/' || o_orderkey || '|customer/' || o_custkey AS ends FROM orders")
def extract_array(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "orders")
    rows = hyperview.long_form(log).where("property = 'customer'")
    return rows.select("object_id", F.array_join(F.concat(P.every("child"), P.every("customer")), "|").alias("ends"))


# Nested views

REGION = HyperSchema("region", "Region", {"r_name": Rule("string")}, properties=("r_name",))
NATION = HyperSchema("nation", "Nation", {"n_name": Rule("string"), "region": Rule("region")}, properties=("n_name", "region"))
CUSTOMER = HyperSchema("customer", "Customer", {"c_name": Rule("string"), "nation": Rule("nation")}, properties=("c_name", "nation"))
ORDER = HyperSchema("order", "Order", {"customer": Rule("customer"), "o_totalprice": Rule("string")})


def _registry(*schemas: HyperSchema) -> Registry:
    out = Registry()
    for s in schemas:
        out.register(s)
    return out


def _opened(props: str, link: str) -> str:
    """The view that the first delta under a link opens into."""
    return f"get(filter(get({props}['{link}'], 0).pointers, p -> p.role = '{link}'), 0).view.{link}"


def _text(props: str, name: str) -> str:
    return f"get(filter(get({props}['{name}'], 0).pointers, p -> p.role = '{name}' AND p.kind = 'str'), 0).str"


@query("SELECT 'orders/' || o_orderkey AS object_id, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def nested_order_customer(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "orders", "customer")
    roots = hyperview.where_property(log, "o_orderstatus", P.primitive("o_orderstatus") == "F")
    plain = HyperSchema("customer", "Customer", {"c_name": Rule("string")}, properties=("c_name",))
    made = hyperview.nested(log, ORDER, _registry(ORDER, plain), roots, negation="none")
    return made.select("object_id", F.expr(_opened("props", "customer")).alias("c")).select("object_id", F.expr(_text("c.props", "c_name")).alias("customer"))


@query("""SELECT 'orders/' || o_orderkey AS object_id, c_name AS customer, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def nested_depth3_all(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "orders", "customer", "nation", "region")
    roots = log.references.where("property = 'customer'").select("object_id")
    made = hyperview.nested(log, ORDER, _registry(ORDER, CUSTOMER, NATION, REGION), roots, negation="none")
    step = made.select("object_id", F.expr(_opened("props", "customer")).alias("c"))
    step = step.select("object_id", F.expr(_text("c.props", "c_name")).alias("customer"), F.expr(_opened("c.props", "nation")).alias("n"))
    step = step.select("object_id", "customer", F.expr(_text("n.props", "n_name")).alias("nation"), F.expr(_opened("n.props", "region")).alias("r"))
    return step.select("object_id", "customer", "nation", F.expr(_text("r.props", "r_name")).alias("region"))


@query("SELECT 'customer/' || c_custkey AS object_id, count(o_orderkey)::BIGINT AS opened, 1::BIGINT AS guarded FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def nested_self_guard_all(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "orders", "customer")
    leaf, top = HyperSchema("leaf", "Leaf"), HyperSchema("top", "Top", {"child": Rule("leaf")})
    roots = log.references.where("property = 'c_name'").select("object_id")
    made = hyperview.nested(log, top, _registry(leaf, top), roots, negation="none")
    flat = made.select("object_id", F.explode(F.flatten(F.map_values("props"))).alias("d")).select("object_id", F.explode("d.pointers").alias("p")).where("p.role = 'child'")
    return flat.groupBy("object_id").agg(F.count("p.view.child").alias("opened"), F.count_if(F.col("p.view.child").isNull()).alias("guarded"))


def _retracted(log: DeltaLog) -> DeltaLog:
    """The log with retractions of every third order's link to its customer, every second of these retracted in turn; of every fifth
    customer's name, every second retracted too; and of every fourth customer's link to its nation."""
    key = F.element_at(F.split("id", "/"), 2).cast("long")
    families = (("orders/%/customer", 3, 0, "n1/", "", 1), ("orders/%/customer", 6, 0, "n2/", "n1/", 2), ("customer/%/c_name", 5, 0, "n3/", "", 3), ("customer/%/c_name", 10, 0, "n4/", "n3/", 4), ("customer/%/nation", 4, 1, "n5/", "", 5))
    made = []
    for like, modulus, rest, name, target, at in families:
        row = bridge.delta(F.concat(F.lit(name), "id"), F.lit(9_000_000_000_000 + at), F.lit("a"), F.lit("s"), F.col("k") + (40 + at) * bridge.SEQ_STEP, P.make("negates", ref_id=F.concat(F.lit(target), "id"), context="negated_by"))
        made.append(F.when(F.col("id").like(like) & (F.col("k") % modulus == rest), row))
    ids = log.deltas.where(" OR ".join(f"id LIKE '{like}'" for like in dict.fromkeys(f[0] for f in families))).select("id", key.alias("k"))
    return DeltaLog(log.deltas.unionByName(ids.select(F.inline(F.filter(F.array(*made), lambda d: d.isNotNull()))).select(*COLUMNS)))


@query("""SELECT 'orders/' || o_orderkey AS object_id, CASE WHEN (o_orderkey % 3 <> 0 OR o_orderkey % 6 = 0) AND (c_custkey % 5 <> 0 OR c_custkey % 10 = 0) THEN c_name END AS customer,
CASE WHEN (o_orderkey % 3 <> 0 OR o_orderkey % 6 = 0) AND c_custkey % 4 <> 1 THEN n_name END AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def nested_retracted(spark, sf_dir):
    """Views in views over a log with retractions and retractions of retractions at each level."""
    log = _retracted(bridge.relational(spark, sf_dir, "orders", "customer", "nation"))
    nation = HyperSchema("nation", "Nation", {"n_name": Rule("string")}, properties=("n_name",))
    roots = log.references.where("property = 'o_totalprice'").select("object_id")
    made = hyperview.nested(log, ORDER, _registry(ORDER, CUSTOMER, nation), roots)
    step = made.select("object_id", F.expr(_opened("props", "customer")).alias("c"))
    step = step.select("object_id", F.expr(_text("c.props", "c_name")).alias("customer"), F.expr(_opened("c.props", "nation")).alias("n"))
    return step.select("object_id", "customer", F.expr(_text("n.props", "n_name")).alias("nation"))


def _customer_views(spark: SparkSession, place: str) -> materialize.Views:
    """A session of its own: nothing known but where the views are, and the schemas."""
    nation = HyperSchema("nation", "Nation", {"n_name": Rule("string")}, properties=("n_name",))
    return materialize.Views(spark, f"{place}/views", _registry(CUSTOMER, nation), Versions())


def _customers(rows: DataFrame) -> DataFrame:
    step = hyperview.packed(rows).select("object_id", F.expr(_text("props", "c_name")).alias("customer"), F.expr(_opened("props", "nation")).alias("n"))
    return step.select("object_id", "customer", F.expr(_text("n.props", "n_name")).alias("nation")).where("customer IS NOT NULL")


@query("SELECT 'customer/' || c_custkey AS object_id, c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def materialized_nested(spark, sf_dir):
    """Stored views with the views inside them, read by a session that did not build them."""
    place = _shared(spark)
    _customer_views(spark, place).materialize(bridge.relational(spark, sf_dir, "customer", "nation"), "customer")
    return _customers(_customer_views(spark, place).rows("customer"))


@query("SELECT 'customer/' || c_custkey AS object_id, c_name AS customer, n_name || '!' AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def affected_nested(spark, sf_dir):
    """Stored views after the objects inside them have changed: every nation is renamed, and another session updates the views."""
    place, log = _shared(spark), bridge.relational(spark, sf_dir, "customer", "nation")
    _customer_views(spark, place).materialize(log, "customer")
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(bridge.named("nation/", F.col("n_nationkey")).alias("object_id"), F.lit("n_name").alias("property"), F.concat("n_name", F.lit("!")).alias("value"))
    fresh = cut(authoring.upsert(log, names, "a", "s", 9_000_000_000_000).withColumn("seq", F.col("seq") + 90 * bridge.SEQ_STEP))
    views = _customer_views(spark, place)
    views.update(DeltaLog(log.deltas.unionByName(fresh)), "customer", fresh.select("id"))
    return _customers(views.rows("customer"))


@query(f"{LIVE} SELECT object_id, property, count(*)::BIGINT AS n, 'events' AS schema_id, 1 AS schema_version FROM shown GROUP BY ALL")
def view_after_restart(spark, sf_dir):
    """Counts of stored views, read, and built again, by sessions that did not build them first."""
    place, log = _shared(spark), _log(spark, sf_dir)
    session = lambda: materialize.Views(spark, f"{place}/views", _registry(EVENT_SCHEMA), Versions())
    session().materialize(log, "events")
    session().rebuild(log, "events")
    return session().get("events").select("object_id", "property", "n", "schema_id", "schema_version")


@query("SELECT 'customer/' || o_custkey AS object_id, count(*)::BIGINT AS orders FROM orders GROUP BY ALL")
def relationship_inverse(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n, c = bridge.named("orders/", F.col("o_orderkey")), bridge.named("customer/", F.col("o_custkey"))
    links = authoring.relationships_from(orders, F.concat(F.lit("rel/"), n), ("order", n, "customer"), ("customer", c, "orders"), F.lit("a"), F.lit("s"), F.lit(1), F.col("o_orderkey"))
    return hyperview.counts(hyperview.long_form(DeltaLog(links))).where("property = 'orders'").select("object_id", F.col("n").alias("orders"))


@query("SELECT 'customer/' || c_custkey AS object_id, n_name AS nation, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey")
def resolved_nested(spark, sf_dir):
    long = hyperview.long_form(bridge.relational(spark, sf_dir, "customer", "nation"))
    customers = view.resolve(long, view.ViewSchema({"nation_id": view.Property("nation", P.reference("nation")), "balance": view.Property("c_acctbal", P.number("c_acctbal"))}))
    nations = view.resolve(long, view.simple({"n_name": P.primitive("n_name")}))
    return view.resolve_nested(customers, "nation_id", nations, "nation_").select("object_id", F.col("nation_n_name").alias("nation"), "balance")


@query("SELECT 'orders/' || o_orderkey AS object_id, o_totalprice AS price FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def multi_root_between(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "orders")
    roots = hyperview.where_property(log, "o_totalprice", P.number("o_totalprice").between(50000, 60000))
    return view.resolve(hyperview.long_form(log, roots), view.ViewSchema({"price": view.Property("o_totalprice", P.number("o_totalprice"))}))


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL)
SELECT 'customer/' || c_custkey AS object_id, n::BIGINT AS suppliers FROM customer JOIN s ON c_nationkey = k""")
def two_hop_collaboration(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "customer", "supplier")
    ends = log.deltas.where("get(pointers, 1).kind = 'ref'").select(F.expr("get(pointers, 0).ref_id").alias("a"), F.expr("get(pointers, 1).ref_id").alias("via"))
    there = ends.where("a LIKE 'supplier/%'").groupBy("via").agg(F.count(F.lit(1)).alias("suppliers"))  # counted before the join, so no pair is listed
    return ends.where("a LIKE 'customer/%'").join(there, "via").select(F.col("a").alias("object_id"), "suppliers")


@query(f"{LIVE} SELECT object_id, count(*)::BIGINT AS n FROM mine GROUP BY ALL ORDER BY n DESC, object_id LIMIT 20")
def top_k_objects(spark, sf_dir):
    return _views(spark, sf_dir).groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "object_id").limit(20)


@query(f"""{LIVE}, c AS (SELECT id FROM mine WHERE object_id IN ('user/1', 'user/2'))
SELECT id FROM dlog WHERE id IN (SELECT id FROM c) OR id IN (SELECT id FROM refs WHERE object_id IN ('user/1', 'user/2'))
  OR id IN (SELECT 'neg' || f || substr(r.id, 4) FROM refs r, (VALUES ('1'), ('b'), ('2'), ('3')) v(f) WHERE r.object_id IN ('user/1', 'user/2'))""")
def nested_closure(spark, sf_dir):
    plain = HyperSchema("user", "User")
    return hyperview.closure(_log(spark, sf_dir), plain, _registry(plain), ["user/1", "user/2"])


# Time travel

_AT = f"WITH {EVENTS}, {gone(T1)}, past AS (SELECT * FROM refs WHERE timestamp <= {T1} AND id NOT IN (SELECT target FROM gone))"


@query(f"{_AT} SELECT object_id, property, count(*)::BIGINT AS n FROM past GROUP BY ALL")
def asof_view(spark, sf_dir):
    return hyperview.counts(timetravel.view_at(_log(spark, sf_dir), None, T1))


@query(f"""WITH {EVENTS} SELECT {T1}::BIGINT AS timestamp, (SELECT count(*) FROM dlog WHERE timestamp <= {T1})::BIGINT AS delta_count,
(SELECT count(DISTINCT target) FROM neg WHERE nt <= {T1})::BIGINT AS negated_count""")
def snapshot(spark, sf_dir):
    return timetravel.snapshot(_log(spark, sf_dir), T1)


@query(f"{LIVE} SELECT DISTINCT object_id, timestamp FROM shown")
def timeline(spark, sf_dir):
    return timetravel.timeline(_log(spark, sf_dir))


_SAMPLED = f"""{LIVE}, t AS (SELECT DISTINCT object_id, timestamp FROM shown WHERE object_id LIKE 'user/%' AND timestamp >= {A} AND timestamp <= {T2}),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY object_id) AS n FROM t),
e AS (SELECT *, CASE WHEN n > 10 THEN n // 10 ELSE 1 END AS every FROM r), s AS (SELECT object_id, timestamp, (i // every)::BIGINT AS step FROM e WHERE i % every = 0)"""


def _times(spark, sf_dir):
    log = _log(spark, sf_dir)
    users = log.references.where("object_id LIKE 'user/%'").select("object_id").distinct()
    return log, timetravel.replay_times(log, users, A, T2, 10)


@query(f"{_SAMPLED} SELECT * FROM s")
def replay_sampled(spark, sf_dir):
    return _times(spark, sf_dir)[1]


@query(f"""{_SAMPLED}, born AS (SELECT object_id, id, timestamp FROM refs WHERE object_id LIKE 'user/%'),
f AS (SELECT 'evt/' || split_part(negator, '/', 2) AS id, min(nt) FILTER (negator LIKE 'neg1/%') AS n1, min(nt) FILTER (negator LIKE 'negb/%') AS nb,
  min(nt) FILTER (negator LIKE 'neg2/%') AS n2, min(nt) FILTER (negator LIKE 'neg3/%') AS n3 FROM neg GROUP BY ALL)
SELECT s.object_id, s.timestamp, count(*) FILTER (NOT (coalesce(nb <= s.timestamp, FALSE) OR (coalesce(n1 <= s.timestamp, FALSE)
  AND NOT (coalesce(n2 <= s.timestamp, FALSE) AND NOT coalesce(n3 <= s.timestamp, FALSE)))))::BIGINT AS n
FROM s JOIN born b ON b.object_id = s.object_id AND b.timestamp <= s.timestamp LEFT JOIN f ON f.id = b.id GROUP BY ALL""")
def replay_counts(spark, sf_dir):
    log, times = _times(spark, sf_dir)
    return timetravel.replay_counts(log, times)


@query(f"""{LIVE} SELECT object_id, id, timestamp, seq, value, lag(value) OVER (PARTITION BY object_id ORDER BY timestamp, seq) AS previous
FROM mine WHERE property = 'purchase'""")
def property_changes(spark, sf_dir):
    return timetravel.property_changes(_log(spark, sf_dir), None, "purchase", P.number("value"))


@query(f"""WITH {EVENTS}, {gone(T1, "a")}, {gone(T2, "b")},
a AS (SELECT object_id, property, count(*) AS n FROM refs WHERE timestamp <= {T1} AND id NOT IN (SELECT target FROM gonea) GROUP BY ALL),
b AS (SELECT object_id, property, count(*) AS n FROM refs WHERE timestamp <= {T2} AND id NOT IN (SELECT target FROM goneb) GROUP BY ALL)
SELECT object_id, property, coalesce(a.n, 0)::BIGINT AS n_before, coalesce(b.n, 0)::BIGINT AS n_after, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS added
FROM a FULL JOIN b USING (object_id, property)""")
def compare_snapshots(spark, sf_dir):
    return timetravel.compare(_log(spark, sf_dir), None, T1, T2)


@query(f"{LIVE} SELECT object_id, arg_min(id, row(timestamp, seq)) AS id, min(timestamp) AS timestamp FROM shown GROUP BY ALL")
def origin(spark, sf_dir):
    return timetravel.origin(_log(spark, sf_dir))


@query(f"""WITH {EVENTS}, {gone(T1)}, d AS (SELECT *, id IN (SELECT target FROM gone) AS g FROM dlog WHERE timestamp <= {T1})
SELECT count(*)::BIGINT AS total, count(*) FILTER (g)::BIGINT AS negated, count(*) FILTER (NOT g)::BIGINT AS active,
count(DISTINCT author)::BIGINT AS authors, count(DISTINCT system)::BIGINT AS systems FROM d""")
def stats_at(spark, sf_dir):
    return timetravel.stats_at(_log(spark, sf_dir), T1)


@query(f"{_AT} SELECT id, timestamp FROM past WHERE object_id IN ({_listed(TARGETS)})")
def time_travel_query(spark, sf_dir):
    return timetravel.query_at(_log(spark, sf_dir), DeltaFilter(target_ids=TARGETS), T1).select("id", "timestamp")


# Schemas as data


def _schema_log(spark: SparkSession, sf_dir: str) -> DeltaLog:
    """A schema for each nation, opening its region's schema by role `region`, and retracted rules for every fifth."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sid, rid = bridge.named("schema/nation", F.col("n_nationkey")), bridge.named("schema/region", F.col("n_regionkey"))
    n, author = F.col("n_nationkey"), F.lit("system")

    def row(kind: str, seq: int, *pointers):
        return bridge.delta(F.concat(sid, F.lit(f"/{kind}")), F.lit(1), author, author, n * 10 + seq, *pointers)

    rows = [
        row("name", 0, P.make("schema", ref_id=sid, context="name"), P.make("name", text=F.col("n_name"), pos=1)),
        row("select", 1, P.make("schema", ref_id=sid, context="select"), P.make("pattern", ref_id=F.lit("by_target_context"), pos=1)),
        row("rule", 2, P.make("schema", ref_id=sid, context="transform"), P.make("on-context", text=F.lit("region"), pos=1), P.make("apply-schema", ref_id=rid, pos=2)),
        row("json", 3, P.make("schema", ref_id=sid, context="transform"), P.make("rules", text=F.concat(F.lit('{"n_name": "string", "part'), n.cast("string"), F.lit('": "integer"}')), pos=1)),
        F.when(n % 5 == 0, row("undo", 4, P.make("negates", ref_id=F.concat(sid, F.lit("/rule")), context="negated_by"))),
    ]
    return DeltaLog(nation.select(F.inline(F.filter(F.array(*rows), lambda d: d.isNotNull()))))


@query("SELECT 'schema/nation' || n_nationkey AS schema_id FROM nation")
def schema_ids(spark, sf_dir):
    return schemadata.schema_ids(_schema_log(spark, sf_dir))


@query("""SELECT 'schema/nation' || n_nationkey AS schema_id, 'region' AS role, 'schema/region' || n_regionkey AS target FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'schema/nation' || n_nationkey, 'n_name', 'string' FROM nation UNION ALL SELECT 'schema/nation' || n_nationkey, 'part' || n_nationkey, 'integer' FROM nation""")
def schema_rules_table(spark, sf_dir):
    return schemadata.rules_table(_schema_log(spark, sf_dir))


@query("SELECT 'schema/nation' || n_nationkey AS schema_id FROM nation WHERE n_regionkey = 2 AND n_nationkey % 5 <> 0")
def schema_dependents(spark, sf_dir):
    return schemadata.dependents(schemadata.rules_table(_schema_log(spark, sf_dir)), "schema/region2")


@query("SELECT 'schema/nation' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 3 END::BIGINT AS rules FROM nation")
def schemas_loaded(spark, sf_dir):
    found = schemadata.load(_schema_log(spark, sf_dir))
    return spark.createDataFrame([(s.id, s.name, len(s.rules)) for s in found.values()], "id string, name string, rules long")


# Authoring


@query("""SELECT 'part/' || p_partkey || '/p_name' AS id, 'p_name' AS role, p_name AS text, NULL::DOUBLE AS num FROM part
UNION ALL SELECT 'part/' || p_partkey || '/p_size', 'p_size', NULL, p_size::DOUBLE FROM part""")
def wide_to_deltas(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = authoring.objects_from(part, bridge.named("part/", F.col("p_partkey")), ["p_name", "p_size"], F.lit("a"), F.lit("s"), F.lit(1), F.col("p_partkey"))
    return made.select("id", F.expr("get(pointers, 1).role").alias("role"), F.expr("get(pointers, 1).str").alias("text"), F.expr("get(pointers, 1).num").alias("num"))


@query("""SELECT 'neg/customer/' || c_custkey || '/c_acctbal' AS id, 'negates' AS role, NULL::DOUBLE AS value FROM customer
UNION ALL SELECT 'set/customer/' || c_custkey || '/c_acctbal/9', 'c_acctbal', round(c_acctbal * 2, 6) FROM customer""")
def upsert_negations_all(spark, sf_dir):
    log = bridge.relational(spark, sf_dir, "customer")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    changes = rows.select(bridge.named("customer/", F.col("c_custkey")).alias("object_id"), F.lit("c_acctbal").alias("property"), F.round(F.col("c_acctbal") * 2, 6).alias("value"))
    made = authoring.upsert(log, changes, "a", "s", 9)
    last = F.element_at("pointers", -1)
    return made.select("id", last["role"].alias("role"), last["num"].alias("value"))


@query(f"WITH {EVENTS} SELECT 'neg/' || id AS id, id AS target, 'wrong' AS reason FROM evt WHERE property = 'error'")
def negate_bulk(spark, sf_dir):
    bad = bridge.events(spark, sf_dir, retractions=False).references.where("property = 'error'").select("id", "timestamp")
    made = authoring.negations_of(bad, "a", "s", F.col("timestamp") + 1, "wrong")
    return made.select("id", P.reference("negates").alias("target"), P.primitive("reason").alias("reason"))


@query(f"WITH {EVENTS} SELECT id, timestamp, author, object_id, property, value, k FROM evt")
def feed_round_trip(spark, sf_dir):
    back = from_feed(to_feed(bridge.events(spark, sf_dir, retractions=False).deltas))
    return DeltaLog(back).references.select("id", "timestamp", "author", "object_id", "property", P.number("value").alias("value"), P.number("k").alias("k"))


# Stored views

EVENT_SCHEMA = HyperSchema("events", "Events", {"value": Rule("integer")}, version=1)


@query(f"{LIVE} SELECT object_id, count(*)::BIGINT AS delta_count, max(timestamp) AS last_updated, max(seq) AS high_seq, 'events' AS schema_id FROM shown GROUP BY ALL")
def materialized_metadata(spark, sf_dir):
    return materialize.metadata(_log(spark, sf_dir), EVENT_SCHEMA).select("object_id", "delta_count", "last_updated", "high_seq", "schema_id")


@query(f"{LIVE} SELECT DISTINCT object_id, 'events' AS schema_id FROM shown WHERE object_id LIKE 'user/%'")
def outdated_views(spark, sf_dir):
    log, versions = _log(spark, sf_dir), Versions()
    stored = materialize.metadata(log, EVENT_SCHEMA).where("object_id LIKE 'user/%'")
    versions.register(HyperSchema("events", "Events", {"value": Rule("string")}, version=2))
    return materialize.outdated(stored, versions)


@query(f"""WITH {EVENTS}, fresh AS (SELECT id, event_id FROM evt WHERE event_id % 100 = 0 UNION ALL SELECT negator, split_part(negator, '/', 2)::BIGINT FROM neg WHERE negator LIKE 'neg2/%1')
SELECT DISTINCT object_id FROM refs WHERE id IN (SELECT id FROM fresh) OR id IN (SELECT 'neg1/' || event_id FROM fresh WHERE id LIKE 'neg2/%') OR id IN (SELECT 'evt/' || event_id FROM fresh WHERE id LIKE 'neg2/%')""")
def affected_roots(spark, sf_dir):
    log = _log(spark, sf_dir)
    fresh = log.deltas.where("(id LIKE 'evt/%' AND seq % 100 = 0) OR id LIKE 'neg2/%1'").select("id")
    return materialize.affected(log, fresh)


@query(f"WITH {EVENTS} SELECT count(*)::BIGINT AS total, max(timestamp) AS latest, count(DISTINCT author)::BIGINT AS authors, count(DISTINCT system)::BIGINT AS systems, (SELECT count(DISTINCT object_id) FROM refs)::BIGINT AS objects FROM dlog")
def log_stats(spark, sf_dir):
    return materialize.stats(_log(spark, sf_dir))


# Merging


@query(f"WITH {EVENTS} SELECT id FROM dlog WHERE author IN ('agent_0', 'agent_6')")
def trust_author(spark, sf_dir):
    return replicate.verified(_log(spark, sf_dir).deltas, Trust(authors=("agent_0", "agent_6")))[0].select("id")


@query(f"WITH {EVENTS} SELECT id FROM dlog WHERE system <> 'node_1'")
def trust_system(spark, sf_dir):
    return replicate.verified(_log(spark, sf_dir).deltas, Trust(systems=("node_0", "node_2")))[0].select("id")


@query(f"WITH {EVENTS} SELECT id, NOT (author IN ('agent_0', 'agent_6', 'agent_3') AND system = 'node_2' AND timestamp < {T1}) AS rejected FROM dlog")
def trust_combined(spark, sf_dir):
    deltas = _log(spark, sf_dir).deltas
    yes, no = replicate.verified(deltas, Trust(authors=("agent_0", "agent_6", "agent_3")), Trust(systems=("node_2",), condition=f"timestamp < {T1}"))
    return yes.select("id", F.lit(False).alias("rejected")).unionAll(no.select("id", F.lit(True).alias("rejected")))


@query(f"WITH {EVENTS} SELECT id, timestamp FROM refs WHERE property <> 'view' AND timestamp >= {T1}")
def sync_set(spark, sf_dir):
    contexts = ["signup", "purchase", "error", "click", "negated_by"]
    return replicate.sync_set(_log(spark, sf_dir), DeltaFilter(target_contexts=contexts), T1).select("id", "timestamp")


@query(f"""WITH {EVENTS}, r AS (SELECT id, row_number() OVER (ORDER BY timestamp, seq) AS n, count(*) OVER () AS c FROM dlog WHERE system = 'node_1')
SELECT id, ((n - 1) // 100 + 1)::BIGINT AS batch_number, (n - 1) // 100 = (c - 1) // 100 AS is_last FROM r""")
def sync_batches(spark, sf_dir):
    rows = replicate.sync_set(_log(spark, sf_dir), DeltaFilter(systems=["node_1"]))
    return replicate.batches(rows).select("id", F.col("batch_number").cast("long"), "is_last")


@query(f"WITH {EVENTS} SELECT author, count(*)::BIGINT AS n, min(seq) AS first_seq FROM dlog WHERE system <> 'node_2' OR timestamp < {T1} GROUP BY ALL")
def merge_replicas(spark, sf_dir):
    whole = _log(spark, sf_dir).deltas
    a, b = DeltaLog(whole.where("system <> 'node_2'")), DeltaLog(whole.where(f"timestamp < {T1}"))
    return replicate.merge(a, b, a).deltas.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {EVENTS} SELECT id FROM dlog WHERE author = 'agent_1' AND NOT timestamp < {T1}")
def merge_missing(spark, sf_dir):
    whole = _log(spark, sf_dir)
    return replicate.missing(whole, DeltaLog(whole.deltas.where(f"timestamp < {T1}")), Trust(authors=("agent_1",))).select("id")


@query(f"WITH {EVENTS} SELECT id FROM refs WHERE system <> 'node_1' AND author IN ('agent_2', 'agent_5') AND property = 'click'")
def link_outgoing(spark, sf_dir):
    trust = Trust(authors=("agent_2", "agent_5"))
    return replicate.outgoing(_log(spark, sf_dir).deltas, "bidirectional", "node_1", DeltaFilter(target_contexts=["click"]), trust).select("id")


@query(f"WITH {EVENTS} SELECT system, count(*)::BIGINT AS received, count(*) FILTER (author IN ('agent_1', 'agent_2'))::BIGINT AS accepted, count(*) FILTER (author NOT IN ('agent_1', 'agent_2'))::BIGINT AS rejected FROM dlog GROUP BY ALL")
def link_stats(spark, sf_dir):
    return replicate.link_stats(_log(spark, sf_dir).deltas, Trust(authors=("agent_1", "agent_2")))


# Buffers and streams


@query("SELECT 'evt/' || event_id AS id FROM events ORDER BY event_id DESC LIMIT 300")
def burst_drop_oldest(spark, sf_dir):
    return streaming.kept(bridge.events(spark, sf_dir, retractions=False).deltas, streaming.Buffer(300)).select("id")


@query("SELECT 'evt/' || event_id AS id FROM events ORDER BY event_id LIMIT 300")
def burst_drop_newest(spark, sf_dir):
    return streaming.kept(bridge.events(spark, sf_dir, retractions=False).deltas, streaming.Buffer(300, "drop_newest")).select("id")


@query("""SELECT count(*)::BIGINT AS received, least(count(*), 300)::BIGINT AS size, 300::BIGINT AS capacity, round(100.0 * least(count(*), 300) / 300, 6)::DOUBLE AS percent_full,
greatest(count(*) - 300, 0)::BIGINT AS dropped, greatest(count(*) - 300, 0)::BIGINT AS overflowed, greatest(least(count(*), 300) - 239, 0)::BIGINT AS warnings FROM events""")
def burst_stats(spark, sf_dir):
    return streaming.buffer_stats(bridge.events(spark, sf_dir, retractions=False).deltas, streaming.Buffer(300))


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{os.urandom(8).hex()}"


@query(f"WITH {EVENTS} SELECT id, timestamp FROM refs WHERE property = 'error'")
def stream_subscribe(spark, sf_dir):
    place = _shared(spark)
    _log(spark, sf_dir).deltas.write.parquet(f"{place}/log")
    out = lambda batch, n: batch.select("id", "timestamp").write.mode("overwrite").parquet(f"{place}/out/batch={n}")
    streaming.subscribe(streaming.source(spark, f"{place}/log"), out, f"{place}/checkpoint", DeltaFilter(target_contexts=["error"])).awaitTermination()
    return spark.read.parquet(f"{place}/out").select("id", "timestamp")


@query(f"{LIVE} SELECT object_id, property, count(*)::BIGINT AS n FROM shown GROUP BY ALL")
def stream_materialize(spark, sf_dir):
    place, log, registry = _shared(spark), _log(spark, sf_dir), _registry(EVENT_SCHEMA)
    views = materialize.Views(spark, f"{place}/views", registry, Versions())
    path = f"{place}/log"
    log.deltas.where("seq < 1000000000").write.parquet(path)
    read = lambda: DeltaLog(spark.read.parquet(path))
    views.materialize(read(), "events")
    log.deltas.where("seq >= 1000000000").write.mode("append").parquet(path)
    streaming.maintain(streaming.source(spark, path).where("seq >= 1000000000"), views, "events", read, f"{place}/checkpoint").awaitTermination()
    return views.get("events").select("object_id", "property", "n")


# Discovery


@query(f"""{LIVE}, v AS (SELECT object_id, property, string_agg(k::BIGINT::VARCHAR, '|' ORDER BY seq) AS ks FROM mine GROUP BY ALL)
SELECT object_id, property, ks FROM v""")
def object_summary(spark, sf_dir):
    rows = hyperview.summary(_log(spark, sf_dir)).where("property <> 'negated_by'")
    every_second = F.filter("values", lambda v, i: i % 2 == 1)
    return rows.select("object_id", "property", F.array_join(every_second, "|").alias("ks"))


@query(f"{LIVE}, f AS (SELECT object_id, min(seq) AS first_seq FROM shown GROUP BY ALL) SELECT object_id, first_seq FROM f ORDER BY first_seq LIMIT 100")
def list_objects(spark, sf_dir):
    return hyperview.objects(_log(spark, sf_dir)).select("object_id", "first_seq")


@query(f"""{LIVE}, s AS (SELECT value, k, seq FROM mine ORDER BY seq LIMIT 100), f AS (SELECT arg_min(value, seq) AS v, arg_min(k, seq) AS k FROM s)
SELECT 'value' AS role, CASE WHEN v = floor(v) THEN 'Int' ELSE 'Float' END AS type FROM f UNION ALL SELECT 'k', CASE WHEN k = floor(k) THEN 'Int' ELSE 'Float' END FROM f""")
def input_type_inference(spark, sf_dir):
    return discovery.input_types(_log(spark, sf_dir))


@query(f"{LIVE} SELECT object_id, arg_min(k, seq)::BIGINT::VARCHAR AS value FROM mine WHERE property = 'click' GROUP BY ALL")
def field_first_value(spark, sf_dir):
    return discovery.first_values(_log(spark, sf_dir), None, "click", "k", "integer")


@query("SELECT 'nation/' || c_nationkey AS object_id, string_agg('customer/' || c_custkey, '|' ORDER BY c_custkey) AS refs FROM customer GROUP BY ALL")
def field_references(spark, sf_dir):
    rows = discovery.reference_lists(bridge.relational(spark, sf_dir, "customer"), None, "customers", "child")
    return rows.select("object_id", F.array_join("refs", "|").alias("refs"))


@query("SELECT 'customer/' || c_custkey AS object_id, c_name AS c_name, 'nation/' || c_nationkey AS nation FROM customer")
def field_selection(spark, sf_dir):
    rows = discovery.select(bridge.relational(spark, sf_dir, "customer"), CUSTOMER, None, ["c_name", "nation"])
    return rows.withColumn("nation", F.array_join("nation", "|"))


@query("""SELECT n_name AS nation, count(*)::BIGINT AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice BETWEEN 50000 AND 90000 AND c_mktsegment = 'BUILDING' GROUP BY ALL""")
def traversal_pipeline(spark, sf_dir):
    """Select roots by a property, go on to what they refer to, filter there, go on, resolve, count."""
    log = bridge.relational(spark, sf_dir, "orders", "customer", "nation")
    long = hyperview.long_form(log, negation="none")
    orders = hyperview.starting(long.where(F.col("property") == "o_totalprice").where(P.number("o_totalprice").between(50000, 90000)))
    customers = hyperview.hop(long, orders, "customer", "customer")
    building = hyperview.having(long, customers, "c_mktsegment", P.primitive("c_mktsegment") == "BUILDING")
    found = hyperview.hop(long, building, "nation", "nation").groupBy("object_id").agg(F.count(F.lit(1)).alias("orders"))
    names = view.resolve(long, view.simple({"n_name": P.primitive("n_name")})).withColumnRenamed("n_name", "nation")
    return found.join(names, "object_id").select("nation", "orders")


@query(f"""WITH {EVENTS} SELECT id, timestamp FROM evt WHERE object_id IN (SELECT object_id FROM evt WHERE event_id % 50 = 7) AND author IN ('agent_1', 'agent_2') AND timestamp BETWEEN {A} AND {B}""")
def index_lookup(spark, sf_dir):
    """By the store's index: targets and authors in a range of time."""
    store = Store(spark, f"{_shared(spark)}/log")
    store.append(_log(spark, sf_dir).deltas)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 50 = 7").select(bridge.named("user/", F.col("user_id")).alias("u")).distinct()
    return store.find(A, B, target=[r["u"] for r in users.collect()], author=["agent_1", "agent_2"]).select("id", "timestamp")


@query(f"WITH {EVENTS} SELECT id, timestamp FROM dlog WHERE author <> 'agent_3' AND (system = 'node_0' OR timestamp >= {B})")
def replicated(spark, sf_dir):
    """Two stores after an exchange by a policy and a filter, over what one of them had; a second exchange adds nothing."""
    place, log = _shared(spark), _log(spark, sf_dir)
    source, target = (Store(spark, f"{place}/{n}") for n in ("source", "target"))
    source.append(log.deltas)
    target.append(log.deltas.where("author <> 'agent_3' AND system = 'node_0'"))
    for _ in range(2):
        replicate.replicate(source, target, Trust(condition="author <> 'agent_3'"), where=DeltaFilter(start=B), audit=f"{place}/audit")
    return target.read().select("id", "timestamp")


@query("SELECT 'not json ' || event_id AS value FROM events WHERE event_id % 3 = 0")
def feed_quarantine(spark, sf_dir):
    """The lines of a feed that are no deltas; the others are read all the same."""
    log = bridge.events(spark, sf_dir, retractions=False)
    broken = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 = 0").select(F.concat(F.lit("not json "), F.col("event_id")).alias("value"))
    lines = to_feed(log.deltas).unionAll(broken)
    return bad_lines(lines).unionAll(from_feed(lines).where("id IS NULL").select(F.col("id").alias("value")))


@query(f"{LIVE} SELECT object_id, property, count(*)::BIGINT AS n FROM shown WHERE object_id IN ('user/1', 'user/2', 'evt/6') GROUP BY ALL")
def stored_view_lookup(spark, sf_dir):
    views = materialize.Views(spark, f"{_shared(spark)}/views", _registry(EVENT_SCHEMA), Versions())
    views.materialize(_log(spark, sf_dir), "events")
    return views.get("events").where(F.col("object_id").isin("user/1", "user/2", "evt/6")).select("object_id", "property", "n")


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'PING' ELSE 'DELTA' END AS type, event_id + 1 AS timestamp FROM events WHERE event_id % 4 IN (0, 1)")
def valid_messages(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_id") % 4
    ping, sent = F.format_string('{"type":"PING","timestamp":%d}', n + 1), F.format_string('{"type":"DELTA","timestamp":%d,"delta":{}}', n + 1)
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(kind == 0, ping).when(kind == 1, sent).when(kind == 2, '{"type":"","timestamp":5}').otherwise("not json").alias("value"))
    return service.valid_messages(lines).select("type", "timestamp")


def worked_example(spark: SparkSession) -> DeltaLog:
    """A post, its author, a comment, and a comment that was retracted."""
    rows = [
        delta("d1", 1000, "alice", "blog", [("named", ref("alice", "name")), ("name", "Alice")]),
        delta("d2", 1001, "alice", "blog", [("post", ref("post", "title")), ("title", "On logs")]),
        delta("d3", 1003, "alice", "blog", [("post", ref("post", "author")), ("author", ref("alice", "posts"))]),
        delta("d4", 2001, "bob", "blog", [("post", ref("post", "comments")), ("comment", ref("c1", "post"))]),
        delta("d5", 3000, "bob", "blog", [("comment", ref("c2", "text")), ("text", "spam")]),
        delta("d6", 3500, "bob", "blog", [("negates", ref("d5", "negated_by")), ("reason", "mistake")]),
    ]
    return DeltaLog(frame(spark, rows))
