"""Object views: for each object and property, the deltas that show there.

The long form, a row for each object, property and delta, is what all else builds on. It comes from the references in one
pass; many objects cost one job. Nested views are built once for each schema, those that open none first, and joined into
the pointers of the views above; between tasks their deltas and views go as compressed blocks, in the long form as texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..checkpoints import cut
from ..functions.pointers import reference, value
from ..model import COLUMNS
from ..plans.schema import SELECTORS, HyperSchema, Registry, Rule, topological
from ..sources.log import DeltaLog
from . import blocks
from .negation import live, unretracted

Roots = DataFrame | list[str] | None


def _rooted(rows: DataFrame, roots: Roots) -> DataFrame:
    if roots is None:
        return rows
    if isinstance(roots, DataFrame):
        return rows.join(roots.select(F.col(roots.columns[0]).alias("object_id")).distinct(), "object_id", "left_semi")
    return rows.where(F.col("object_id").isin(roots) if roots else F.lit(False))


def long_form(log: DeltaLog, roots: Roots = None, asof: int | None = None, negation: str = "full", selector: str = "by_target_context") -> DataFrame:
    """(object_id, property, and the delta) of the objects in roots (a list of ids, a DataFrame of them, or None for all).

    With the selector by target context a delta shows once for each pointer to the object, so possibly twice under a
    property; pointers without a context show nowhere. Other selectors see each delta that refers to the object once.
    """
    rows = live(log, asof, negation) if negation != "none" else log.until(asof)
    if selector == "by_target_context":
        return _rooted(rows.references.where("property IS NOT NULL"), roots).select("object_id", "property", *COLUMNS)
    pairs = _rooted(rows.references, roots).dropDuplicates(["object_id", "id"])
    return pairs.drop("property").withColumn("property", F.explode(SELECTORS[selector](F.col("object_id")))).select("object_id", "property", *COLUMNS)


def counts(long: DataFrame) -> DataFrame:
    """(object_id, property, n): deltas, those that show twice counted twice."""
    return long.groupBy("object_id", "property").agg(F.count(F.lit(1)).alias("n"))


def _delta() -> Column:
    return F.struct(F.col("seq"), *(F.col(c) for c in COLUMNS if c != "seq"))


def packed(long: DataFrame) -> DataFrame:
    """(object_id, props): props maps each property to its deltas in order of arrival."""
    by_seq = lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int")  # noqa: E731  opened pointers hold maps, which have no order
    lists = long.groupBy("object_id", "property").agg(F.array_sort(F.collect_list(_delta()), by_seq).alias("deltas"))
    return lists.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("property", "deltas"))).alias("props"))


def nested(log: DeltaLog, schema: HyperSchema | str, registry: Registry, roots: Roots = None, asof: int | None = None, negation: str = "full") -> DataFrame:
    """(object_id, props) as packed(), of the rows of nested_long(): a row an object. All that an object's view needs meets in one exchange."""
    return _packed_view(*_levels(log, schema, registry, roots, asof, negation))


def nested_long(log: DeltaLog, schema: HyperSchema | str, registry: Registry, roots: Roots = None, asof: int | None = None, negation: str = "full") -> DataFrame:
    """The long form of the roots with pointers opened by the schema's rules. A row a delta, so an object may have any number of
    referrers; only what is opened is packed.

    Each pointer has a field `view`, with a field for each role that opens one: the packed view of the object that it refers
    to, under the rule's schema. A pointer opens if its role has a rule for a schema, it is a reference, the rule's condition
    holds, and it does not lead back to the object whose view it is in. All levels see the log as of the same time. The log
    is read some times a level, as it is far larger on disk than the tables or files it comes from; only ids of retractions and the ids that a level
    refers to are kept in the shared folder, and only views that are referred to from above are built.
    """
    rows, s, roots, links, built, *_ = _levels(log, schema, registry, roots, asof, negation)
    if not s.nested:
        return _shown(rows, s, roots)
    items, kind = _items(rows, s, roots, links, built)
    opened = F.explode(_read("items", kind, s, built)).alias("d")
    return items.groupBy("object_id", "property", "id").agg(F.collect_list("item").alias("items")).select("object_id", "property", opened).select("object_id", "property", *(f"d.{c}" for c in COLUMNS))


#: So many views of a level are built before the level above, which keeps its plan short; more are built as they are used. So few roots
#: are looked for by their ids.
FEW = 1000
#: Deltas of the log to a part in which objects meet, about.
PART = 200_000
LINK = T.StructType([T.StructField(n, T.IntegerType() if n == "at" else T.StringType()) for n in ("object_id", "id", "at", "role", "_to")])
Level = tuple[DeltaLog, HyperSchema, Roots, DataFrame | None, dict[str, DataFrame], int, set[str], DataFrame | None]


def _levels(log: DeltaLog, schema: HyperSchema | str, registry: Registry, roots: Roots, asof: int | None, negation: str) -> Level:
    """The top level: (log, schema, roots, what opens, views by schema of what it refers to, parts, schemas with few views, dealt roots), for _items() and _packed_view()."""
    top = registry.resolve(schema)
    rows, size = unretracted(log, asof, negation) if negation != "none" else (log.until(asof), log.until(asof).deltas.count())
    parts = max(1, -(-size // PART))
    order = topological({**registry, top.id: top}, [top.id])
    wanted: dict[str, Roots] = {top.id: roots}
    links: dict[str, DataFrame | None] = {}
    at: dict[str, DataFrame | None] = {}
    for s in reversed(order):  # from the top: which objects each level needs
        wanted[s.id] = _few(wanted[s.id])
        at[s.id] = _dealt_roots(wanted[s.id], parts)
        links[s.id] = _kept(_links(rows, s, wanted[s.id]), at[s.id], parts) if s.nested else None
        for target, roles in _targets(s).items():
            registry.resolve(target)
            referred = cut(links[s.id].where(F.col("role").isin(roles)).select(F.col("_to").alias("object_id")).distinct())
            before = wanted.get(target)
            wanted[target] = referred if before is None else before.unionAll(referred)
    built: dict[str, DataFrame] = {}
    few = {id for id, ids in wanted.items() if isinstance(ids, list)}
    for s in order:
        if s.id != top.id:
            views = _packed_view(rows, s, wanted[s.id], links[s.id], built, parts, few, at[s.id])
            built[s.id] = cut(views) if s.id in few else views
    return rows, top, wanted[top.id], links[top.id], built, parts, few, at[top.id]


def _few(roots: Roots) -> Roots:
    """A short table of roots as a list."""
    if not isinstance(roots, DataFrame):
        return roots
    ids = [r[0] for r in roots.select(roots.columns[0]).limit(FEW + 1).collect()]
    return roots if len(ids) > FEW else sorted({i for i in ids if i is not None})


def _dealt_roots(roots: Roots, parts: int) -> DataFrame | None:
    """Blocks of a table of roots, computed once."""
    if not isinstance(roots, DataFrame):
        return None
    return cut(blocks.deal(roots.select(F.col(roots.columns[0]).alias("object_id")), "object_id", ROOTS, parts))


def _kept(links: DataFrame, roots: DataFrame | None, parts: int) -> DataFrame:
    """The links of the roots, if these are a table; the log is read for them once."""
    links = links.select(*(F.col(f.name).alias(f.name) for f in LINK))
    dealt = [cut(blocks.deal(links, "object_id", LINKS, parts))]
    late = roots is not None
    if late:
        dealt.append(roots)

    def run(at: blocks.Tables) -> Iterator[pa.RecordBatch]:
        own = at.get(LINKS) if not late or ROOTS in at else None
        if own is not None:
            own = own.filter(pc.is_in(own["object_id"], blocks.column(at[ROOTS], "object_id"), skip_nulls=True)) if late else own
            yield from pa.Table.from_arrays(own.columns, schema=schema).to_batches()

    schema = to_arrow_schema(LINK)
    return blocks.meet(dealt, parts, run, LINK)


def _targets(s: HyperSchema) -> dict[str, list[str]]:
    """Roles that open, by the schema that they open into."""
    out: dict[str, list[str]] = {}
    for role, rule in s.nested.items():
        out.setdefault(rule.schema, []).append(role)
    return out


def _shown(rows: DeltaLog, s: HyperSchema, roots: Roots) -> DataFrame:
    """The long form under a schema, nothing opened."""
    if s.properties and s.selector == "by_target_context":  # what has none of them is left out before it is opened by reference
        rows = DeltaLog(rows.deltas.where(reduce(lambda a, b: a | b, (F.coalesce(F.array_contains(F.col("pointers.ref_context"), p), F.lit(False)) for p in s.properties))))
    own = long_form(rows, roots, negation="none", selector=s.selector)
    if s.properties is None:
        return own
    return own.where(F.col("property").isin(list(s.properties)) if s.properties else F.lit(False))


def _may_open(s: HyperSchema) -> Column:
    """Whether a delta has a pointer that a role opens; the rule's condition may still forbid it."""
    named = reduce(lambda a, b: a | b, (F.coalesce(F.array_contains(F.col("pointers.role"), r), F.lit(False)) for r in s.nested))
    return named & F.exists("pointers", lambda p: F.coalesce((p["kind"] == "ref") & p["role"].isin(list(s.nested)), F.lit(False)))


def _links(rows: DeltaLog, s: HyperSchema, roots: Roots) -> DataFrame:
    """(object_id, id, at, role, _to): the pointers that open, of deltas that show on the roots. Narrow before anything is exchanged.
    A table of roots is not met here, but where the views are gathered."""
    may = _may_open(s)
    listed = None if isinstance(roots, DataFrame) else roots
    if s.selector == "by_target_context":
        own = _shown(DeltaLog(rows.deltas.where(may)), s, listed)
    else:
        own = _shown(rows, s, listed).where(may)
    flat = own.select("object_id", *(c for c in COLUMNS if c != "pointers"), F.posexplode("pointers").alias("at", "p"))
    opens = [_opens(role, rule) for role, rule in s.nested.items()]
    return flat.where(reduce(lambda a, b: a | b, opens)).select("object_id", "id", "at", F.col("p.role").alias("role"), F.col("p.ref_id").alias("_to"))


def _opens(role: str, rule: Rule, p: str = "p") -> Column:
    """Whether a pointer opens: by role and kind, not back to the object itself, and by the rule's condition."""
    test = (F.col(f"{p}.role") == role) & (F.col(f"{p}.kind") == "ref") & (F.col(f"{p}.ref_id") != F.col("object_id"))
    return test & F.expr(rule.when) if rule.when else test


def _referred(long: DataFrame, role: str, rule: Rule) -> DataFrame:
    """(object_id) of what pointers with the role open into."""
    flat = long.select("object_id", *(c for c in COLUMNS if c != "pointers"), F.explode("pointers").alias("p"))
    return flat.where(_opens(role, rule)).select(F.col("p.ref_id").alias("object_id"))


#: Stands for the object's own id in texts. JSON holds control characters only escaped, so it is nothing else.
OWN = "\x04"
JSON = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1), "maxNestingDepth": str(2**31 - 1)}


def _open(kind: T.DataType, short: bool = False) -> T.DataType:
    """The type with nulls allowed, as what is read from a text may be null. short: with fields named by letters."""
    if isinstance(kind, T.StructType):
        names = [chr(97 + i) if i < 26 else f"a{i}" for i in range(len(kind))] if short else kind.names
        return T.StructType([T.StructField(n, _open(f.dataType, short)) for n, f in zip(names, kind)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_open(kind.elementType, short))
    return T.MapType(kind.keyType, _open(kind.valueType, short)) if isinstance(kind, T.MapType) else kind


def _text(c: Column, kind: T.DataType, own: Column) -> Column:
    """A delta or a view as text, which is a third of its row's size on disk; _struct() gives it back."""
    return F.replace(F.to_json(c.cast(_open(kind, True))), F.coalesce(own, F.lit("")), F.lit(OWN))


def _struct(c: Column, kind: T.DataType, own: Column) -> Column:
    return F.from_json(F.replace(c, F.lit(OWN), F.coalesce(own, F.lit(""))), _open(kind, True), JSON).cast(kind)


def _kind(df: DataFrame, c: Column) -> T.DataType:
    return _open(df.select(c.alias("c")).schema["c"].dataType)


def _items(rows: DeltaLog, s: HyperSchema, roots: Roots, links: DataFrame, built: dict[str, DataFrame]) -> tuple[DataFrame, T.DataType]:
    """(object_id, property, id, item), and the deltas' type. An item (d, views) is a delta as text with the views that its pointers open into,
    (at, role, v), as texts too; _read() reads them. A delta that shows twice on an object has two items, opened once. An object's deltas
    are dealt singly.
    """
    late = s.selector == "by_target_context" and isinstance(roots, DataFrame)  # roots are met where the views are gathered
    own = _shown(rows, s, None if late else roots)
    kind = _kind(own, _delta())
    out = own.select("object_id", "property", "id", _text(_delta(), kind, F.col("object_id")).alias("d"), F.lit(None).cast("struct<at int, role string, v string>").alias("view"))
    for target, roles in _targets(s).items():
        view = built[target].select("object_id", F.struct("object_id", "props").alias("v"))
        view = view.select(F.col("object_id").alias("_to"), _text(F.col("v"), view.schema["v"].dataType, F.col("object_id")).alias("v"))
        found = links.where(F.col("role").isin(roles)).join(view, "_to")
        none = F.lit(None)
        out = out.unionAll(found.select("object_id", none.alias("property"), "id", none.alias("d"), F.struct("at", "role", "v").alias("view")))
    out = _rooted(out, roots if late else None)
    shown = F.when(F.col("d").isNotNull(), F.struct("property", "d"))
    out = out.groupBy("object_id", "id").agg(F.collect_list(shown).alias("ds"), F.collect_list("view").alias("views"))
    out = out.select("object_id", "id", F.explode("ds").alias("x"), "views")
    return out.select("object_id", "x.property", "id", F.struct("x.d", "views").alias("item")), kind


def _read(items: Column | str, kind: T.DataType, s: HyperSchema, built: dict[str, DataFrame]) -> Column:
    """The deltas of a column of items of an object, in order of arrival, pointers opened."""
    by_seq = lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int")
    kinds = {t: _kind(built[t], F.struct("object_id", "props")) for t in _targets(s)}
    # a text is read once, then its fields are taken
    read = F.transform(items, lambda x: F.struct(_struct(x["d"], kind, F.col("object_id")).alias("d"), x["views"].alias("views")))

    def opened(p: Column, at: Column, views: Column) -> Column:
        view = F.get(F.filter(views, lambda x: x["at"] == at), F.lit(0))
        fields = [F.when(view["role"] == r, _struct(view["v"], kinds[rule.schema], p["ref_id"])).alias(r) for r, rule in s.nested.items()]
        return p.withField("view", F.when(view.isNotNull(), F.struct(*fields)))

    def delta(y: Column) -> Column:
        fields = [y["d"][f].alias(f) for f in kind.names if f != "pointers"]
        return F.struct(*fields, F.transform(y["d"]["pointers"], lambda p, i: opened(p, i, y["views"])).alias("pointers"))

    return F.array_sort(F.transform(read, delta), by_seq)


#: Tags of what meets by object: its deltas, the roots, links, views; views that its pointers open into have the tags from FOUND on, one for each schema.
DELTAS, ROOTS, LINKS, VIEWS, FOUND = range(5)
#: Deltas of the objects that are packed at once.
AT_ONCE = 10_000


def _packed_view(rows: DeltaLog, s: HyperSchema, roots: Roots, links: DataFrame | None, built: dict[str, DataFrame], parts: int, few: set[str], at: DataFrame | None) -> DataFrame:
    """(object_id, props) of the roots under a schema, pointers opened. An object's deltas, and the views that they open into, meet in one part."""
    late = s.selector == "by_target_context" and isinstance(roots, DataFrame)  # roots are met where the object's deltas are
    own = _shown(rows, s, None if late else roots)
    kind = _kind(own, _delta())
    dealt = [blocks.deal(own.select("object_id", "property", _delta().alias("d")), "object_id", DELTAS, parts)]
    if late:
        dealt.append(at)
    targets = list(_targets(s).items())
    opened: dict[str, T.DataType] = {}
    for i, (target, roles) in enumerate(targets):
        view = built[target].select(F.col("object_id").alias("_to"), F.struct("object_id", "props").alias("v"))
        opened[target] = _open(view.schema["v"].dataType)
        dealt.append(_found(links.where(F.col("role").isin(roles)), view, target in few, FOUND + i, parts))
    if s.nested:
        pointer = kind["pointers"].dataType.elementType
        fields = [T.StructField(r, opened[rule.schema]) for r, rule in s.nested.items()]
        kind = T.StructType([*(f for f in kind if f.name != "pointers"), T.StructField("pointers", T.ArrayType(T.StructType([*pointer, T.StructField("view", T.StructType(fields))])))])
    schema = T.StructType([T.StructField("object_id", T.StringType()), T.StructField("props", T.MapType(T.StringType(), T.ArrayType(kind)))])
    roles = [(r, FOUND + [t for t, _ in targets].index(rule.schema)) for r, rule in s.nested.items()]
    return blocks.meet(dealt, parts, _packer(roles, to_arrow_schema(schema), late), schema)


def _found(links: DataFrame, view: DataFrame, few: bool, tag: int, parts: int) -> DataFrame:
    """Blocks by object of (object_id, id, at, role, v): the views (_to, v) that the links open into."""
    if few:
        found = links.join(F.broadcast(view), "_to").select("object_id", "id", "at", "role", "v")
        return blocks.deal(found, "object_id", tag, parts)

    def run(at: blocks.Tables) -> Iterator[pa.RecordBatch]:
        if LINKS in at and VIEWS in at:
            v = blocks.column(at[VIEWS], "v")
            places = pc.index_in(blocks.column(at[LINKS], "_to"), blocks.column(at[VIEWS], "_to"), skip_nulls=True)
            own = at[LINKS].append_column("_at", places).filter(pc.is_valid(places)).combine_chunks()
            place, narrow = own["_at"].to_numpy(), own.select(["object_id", "id", "at", "role"])
            yield from blocks.sent(own["to_part"].to_numpy(), tag, lambda x: narrow.take(x).append_column("v", v.take(pa.array(place[x]))))

    fewer = max(1, parts // 8)  # a link is far shorter than a delta
    by_target = blocks.deal(links.withColumn("to_part", blocks.part("object_id", parts)), "_to", LINKS, fewer)
    return blocks.meet([by_target, blocks.deal(view, "_to", VIEWS, fewer)], fewer, run, blocks.SCHEMA)


def _packer(roles: list[tuple[str, int]], schema: pa.Schema, late: bool) -> Callable[[blocks.Tables], Iterator[pa.RecordBatch]]:
    """Makes an object's deltas a row. roles: those that open, with the tag of their views. late: roots are among the tables."""
    kind = schema.field("props").type
    delta = kind.item_type.value_type

    def run(at: blocks.Tables) -> Iterator[pa.RecordBatch]:
        rows = at.get(DELTAS)
        if rows is not None and late:
            rows = rows.filter(pc.is_in(rows["object_id"], blocks.column(at[ROOTS], "object_id"), skip_nulls=True)) if ROOTS in at else None
        if not rows:
            return
        views = {t: at[t] for t in dict(map(reversed, roles)) if t in at}
        objects, *others = blocks.codes(blocks.column(rows, "object_id"), *(blocks.column(t, "object_id") for t in views.values()))
        (names,) = blocks.codes(blocks.column(rows, "property"))
        order = np.lexsort((pc.struct_field(blocks.column(rows, "d"), "seq").to_numpy(zero_copy_only=False), names, objects))
        rows, objects, names = rows.take(order), objects[order], names[order]
        d, ids, properties = (blocks.column(rows, c) for c in ("d", "object_id", "property"))
        ends, places = _places(d, objects, views, others)
        starts = np.flatnonzero(np.diff(objects, prepend=-1))
        cuts = [int(x) for x in starts[np.flatnonzero(np.diff(starts // AT_ONCE, prepend=-1))]]
        for a, b in zip(cuts, [*cuts[1:], len(objects)]):
            new = np.diff(objects[a:b], prepend=-1) != 0
            group, first = np.flatnonzero(new | (np.diff(names[a:b], prepend=-1) != 0)), np.flatnonzero(new)
            opened = [(r, views[t], places[t][ends[a] : ends[b]]) if t in views else (r, None, None) for r, t in roles]
            values = _opened(d.slice(a, b - a), opened, delta)
            lists = pa.ListArray.from_arrays(pa.array([*group, b - a], pa.int32()), values, type=kind.item_type)
            keys = properties.slice(a, b - a).take(pa.array(group))
            props = pa.MapArray.from_arrays(pa.array([*np.searchsorted(group, first), len(group)], pa.int32()), keys, lists, type=kind)
            yield pa.record_batch([ids.slice(a, b - a).take(pa.array(first)), props], schema=schema)

    return run


def _places(d: pa.Array, objects: np.ndarray, views: blocks.Tables, others: list[np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(where each delta's pointers begin, all counted through; by tag, each pointer's row among the views, or -1).

    objects, others: numbers of the object of each delta, and of each row of the views.
    """
    length = pc.fill_null(pc.list_value_length(pc.struct_field(d, "pointers")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(length)])
    row = np.repeat(np.arange(len(d)), length)
    within = np.arange(len(row)) - ends[row]
    deltas, *theirs = blocks.codes(pc.struct_field(d, "id"), *(blocks.column(t, "id") for t in views.values()))
    wide, most = 1 + max(x.max() for x in (deltas, *theirs)), 1 + length.max()
    mine = (objects[row] * wide + deltas[row]) * most + within
    places = {}
    for (tag, t), own, id in zip(views.items(), others, theirs):
        keys = (own * wide + id) * most + t["at"].to_numpy()
        order = np.argsort(keys, kind="stable")
        at = np.minimum(np.searchsorted(keys[order], mine), len(order) - 1)
        places[tag] = np.where(keys[order[at]] == mine, order[at], -1)
    return ends, places


def _opened(d: pa.Array, roles: list[tuple[str, pa.Table | None, np.ndarray | None]], kind: pa.StructType) -> pa.Array:
    """Deltas with what their pointers open into. roles: (role, views, each pointer's row among these or -1)."""
    lists = pc.struct_field(d, "pointers")
    flat, pointer = lists.flatten(), kind.field("pointers").type.value_type
    inner = [pc.struct_field(flat, f.name) for f in pointer if f.name != "view"]
    if roles:
        fields, seen, made = list(pointer.field("view").type), np.zeros(len(flat), bool), []
        for (role, views, place), f in zip(roles, fields):
            if views is None:
                made.append(pa.nulls(len(flat), f.type))
                continue
            hit = (place >= 0) & np.append(pc.fill_null(pc.equal(blocks.column(views, "role"), role), False).to_numpy(zero_copy_only=False), False)[place]
            made.append(blocks.column(views, "v").take(pa.array(place, mask=~hit)))
            seen |= place >= 0
        inner.append(pa.StructArray.from_arrays(made, fields=fields, mask=pa.array(~seen)))
    values = pa.StructArray.from_arrays(inner, fields=list(pointer), mask=flat.is_null())
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    pointers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), values, type=kind.field("pointers").type, mask=lists.is_null())
    return pa.StructArray.from_arrays([pointers if f.name == "pointers" else pc.struct_field(d, f.name) for f in kind], fields=list(kind))


def closure(log: DeltaLog, schema: HyperSchema | str, registry: Registry, roots: list[str] | DataFrame, asof: int | None = None) -> DataFrame:
    """(id) of every delta that the nested view of the roots depends on: theirs, those of opened objects, and retractions of any of these."""
    top = registry.resolve(schema)
    rows = log.until(asof)
    wanted: dict[str, DataFrame | list[str]] = {top.id: roots}
    ids: DataFrame | None = None
    for s in reversed(topological({**registry, top.id: top}, [top.id])):
        own = long_form(rows, wanted[s.id], negation="none", selector=s.selector)
        ids = own.select("id") if ids is None else ids.unionAll(own.select("id"))
        for role, rule in s.nested.items():
            referred = _referred(own, role, rule)
            before = wanted.get(rule.schema)
            wanted[rule.schema] = referred if before is None else before.unionAll(referred)
    ids = cut(ids.distinct())
    edges = rows.negations.select("negator_id", "target_id")
    out = ids
    layer = ids
    while True:  # retractions of retractions, a layer at a time; their chains are short
        layer = cut(edges.join(layer.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("negator_id").alias("id")).distinct().join(out, "id", "left_anti"))
        if layer.isEmpty():
            return out
        out = out.unionAll(layer)


def where_property(log: DeltaLog, property: str, test: Column, asof: int | None = None) -> DataFrame:
    """(object_id) of the objects that have a delta under the property for which the test holds: roots for a view of many."""
    return long_form(log, None, asof).where((F.col("property") == property) & test).select("object_id").distinct()


def summary(log: DeltaLog, roots: Roots = None) -> DataFrame:
    """(object_id, property, values): for each object the other targets of its deltas, as text, by property in order of arrival.

    References back to the object are left out; a delta without other targets adds nothing.
    """
    others = F.filter("pointers", lambda p: F.coalesce(p["ref_id"] != F.col("object_id"), F.lit(True)))
    rows = long_form(log, roots).select("object_id", "property", "seq", F.posexplode(others).alias("at", "p"))
    lists = rows.groupBy("object_id", "property").agg(F.array_sort(F.collect_list(F.struct("seq", "at", value(F.col("p")).alias("v")))).alias("l"))
    return lists.select("object_id", "property", F.col("l.v").alias("values"))


def objects(log: DeltaLog, limit: int | None = 100) -> DataFrame:
    """(object_id, first_seq, first_pos) of what live deltas refer to, in the order of first mention."""
    seen = live(log).references.groupBy("object_id").agg(F.min(F.struct("seq", "pos")).alias("f"))
    rows = seen.select("object_id", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos")).orderBy("first_seq", "first_pos")
    return rows.limit(limit) if limit else rows


def hop(long: DataFrame, start: DataFrame, property: str, role: str, test: Column | None = None) -> DataFrame:
    """(root, object_id): from what start (root, object_id) has reached on to what deltas under the property refer to in the role.

    long: a long form, whose rows are judged by test, if given. A root that reaches an object twice has two rows.
    """
    rows = long.where(F.col("property") == property)
    rows = rows if test is None else rows.where(test)
    steps = rows.select("object_id", reference(role).alias("_to")).where("_to IS NOT NULL")
    return start.join(steps, "object_id").select("root", F.col("_to").alias("object_id"))


def having(long: DataFrame, start: DataFrame, property: str, test: Column) -> DataFrame:
    """Of start (root, object_id) the rows whose object has a delta under the property for which the test holds."""
    return start.join(long.where((F.col("property") == property) & test).select("object_id"), "object_id", "left_semi").select("root", "object_id")


def starting(objects: DataFrame) -> DataFrame:
    """(root, object_id) of objects (object_id), each its own root: where a traversal starts."""
    return objects.select(F.col("object_id").alias("root"), "object_id").distinct()
