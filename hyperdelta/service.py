"""A facade of plain values in and out, for tools that call the engine by name."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Target, as_json, frame
from .operators import authoring, filters, hyperview, materialize, negation, timetravel
from .operators.filters import DeltaFilter
from .plans import schemadata
from .plans.schema import HyperSchema, Registry, Rule, Versions
from .sources.log import DeltaLog, Store

MESSAGE_FIELDS = ("type", "timestamp")


@dataclass(frozen=True)
class Config:
    """Where the store lies and under which name it writes."""

    path: str
    system: str = "local"
    validate_schemas: bool = False
    use_index: bool = True  # look up targets, contexts and authors by the store's index

    @classmethod
    def from_env(cls) -> Config:
        env = os.environ.get
        return cls(env("HYPERDELTA_PATH", "deltas"), env("HYPERDELTA_SYSTEM", "local"), env("HYPERDELTA_VALIDATE", "") == "1", env("HYPERDELTA_INDEX", "1") == "1")


#: A named query of the user's: the service and its arguments in, plain values out.
Resolver = Callable[..., Any]


class Service:
    """Calls take and give what JSON can hold. A call's result is small by its nature or by its limit."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config, self.store = spark, config, Store(spark, config.path)
        self.registry, self.versions = Registry(), Versions()
        self._snapshots: dict[str, str] = {}
        self.resolvers: dict[str, Resolver] = {}

    def add_resolver(self, name: str, resolver: Resolver) -> None:
        """A query of the user's own under a name, to be called like the service's."""
        if hasattr(type(self), name):
            raise ValueError(f"{name!r} is one of the service's own calls")
        self.resolvers[name] = resolver

    def call(self, name: str, **arguments: Any) -> Any:
        """A call by its name: the service's own or a user's."""
        if name in self.resolvers:
            return self.resolvers[name](self, **arguments)
        if name.startswith("_") or not callable(getattr(type(self), name, None)):
            raise LookupError(f"no call {name!r}")
        return getattr(self, name)(**arguments)

    @property
    def log(self) -> DeltaLog:
        return self.store.log()

    @cached_property
    def views(self) -> materialize.Views:
        return materialize.Views(self.spark, f"{self.config.path}-views", self.registry, self.versions)

    def _persist(self, rows: Iterable[tuple]) -> list[dict[str, Any]]:
        rows = [(*r[:4], i, r[5]) for i, r in enumerate(rows)]
        df = frame(self.spark, rows)
        self.store.append(df)
        return [as_json(r) for r in df.orderBy("seq").collect()]

    # writing

    def create_delta(self, author: str, pointers: list[dict[str, Any]], id: str | None = None, timestamp: int | None = None) -> dict[str, Any]:
        return self._persist([authoring.create(author, self.config.system, [(p["role"], p["target"]) for p in pointers], id, timestamp)])[0]

    def create_object(self, author: str, object_id: str, properties: dict[str, Target | None], timestamp: int | None = None) -> list[dict[str, Any]]:
        """A delta for each property with a value; a leading underscore is not part of the role."""
        made = []
        for name, value in properties.items():
            if value is not None:
                role = name.removeprefix("_")
                made.append(authoring.create(author, self.config.system, [("entity", {"id": object_id, "context": name}), (role, value)], timestamp=timestamp))
        return self._persist(made)

    def create_relationship(self, author: str, one: tuple[str, str, str], other: tuple[str, str, str], timestamp: int | None = None) -> dict[str, Any]:
        """one and other: (role, object id, property)."""
        ends = [(role, {"id": id, "context": context}) for role, id, context in (one, other)]
        return self._persist([authoring.create(author, self.config.system, ends, timestamp=timestamp)])[0]

    def negate_delta(self, author: str, target_id: str, reason: str | None = None, timestamp: int | None = None) -> dict[str, Any]:
        return self._persist([authoring.negate(author, self.config.system, target_id, reason, timestamp=timestamp)])[0]

    def update_object(self, author: str, object_id: str, properties: dict[str, str | float | bool | None], timestamp: int) -> int:
        """Retracts what is live under the properties, and writes the new values, each of its kind; how many deltas that took. None
        writes nothing in place of what is retracted."""

        def tagged(v: str | float | bool | None) -> tuple[str | None, float | None, bool | None]:
            if isinstance(v, bool):
                return None, None, v
            return (None, float(v), None) if isinstance(v, (int, float)) else (v, None, None)

        rows = [(object_id, k, tagged(v)) for k, v in properties.items()]
        changes = self.spark.createDataFrame(rows, "object_id string, property string, value struct<str:string,num:double,bool:boolean>")
        made = authoring.upsert(self.log, changes, author, self.config.system, timestamp).collect()
        self._persist([tuple(r) for r in made])
        return len(made)

    # reading

    @staticmethod
    def _filter(query: dict[str, Any]) -> DeltaFilter:
        names = {"ids": "ids", "targetIds": "target_ids", "targetContexts": "target_contexts", "authors": "authors", "systems": "systems", "timestampStart": "start", "timestampEnd": "end", "includeNegated": "include_negated"}
        unknown = set(query) - set(names) - {"limit"}
        if unknown:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        return DeltaFilter(**{names[k]: v for k, v in query.items() if k in names and v is not None})

    def query_deltas(self, asof: int | None = None, **query: Any) -> dict[str, Any]:
        """The deltas, at most `limit` of them, and how many there are without the limit."""
        where = self._filter(query)
        log = self.log
        if self.config.use_index and (where.target_ids is not None or where.target_contexts is not None or where.authors is not None):
            end = asof if where.end is None else where.end if asof is None else min(asof, where.end)
            hits = self.store.find(where.start, end, target=where.target_ids, context=where.target_contexts, author=where.authors)
            rows = hits.where(where.condition())
            if not where.include_negated:
                rows = rows.join(negation.negated_ids(log, asof), "id", "left_anti")
        else:
            rows = filters.query(log, where, asof)
        return {"count": rows.count(), "deltas": [as_json(r) for r in filters.first(rows, query.get("limit")).collect()]}

    def get_object_deltas(self, object_id: str, include_negated: bool = False) -> dict[str, Any]:
        return self.query_deltas(targetIds=[object_id], includeNegated=include_negated)

    def time_travel_query(self, timestamp: int, target_ids: list[str] | None = None) -> dict[str, Any]:
        return self.query_deltas(asof=timestamp, **({"targetIds": target_ids} if target_ids is not None else {}))

    def get_delta(self, id: str) -> dict[str, Any] | None:
        row = filters.by_ids(self.log, [id]).first()
        return as_json(row) if row else None

    def get_object(self, object_id: str) -> dict[str, Any]:
        """Its properties; a property with one value is that value."""
        rows = hyperview.summary(self.log, [object_id]).collect()
        return {"id": object_id, **{r["property"]: r["values"][0] if len(r["values"]) == 1 else list(r["values"]) for r in rows}}

    def list_objects(self, limit: int = 100) -> list[str]:
        return [r["object_id"] for r in hyperview.objects(self.log, limit).collect()]

    def get_view(self, schema_id: str, object_id: str, asof: int | None = None) -> dict[str, Any] | None:
        row = hyperview.nested(self.log, schema_id, self.registry, [object_id], asof).first()
        return row.asDict(recursive=True) if row else None

    def get_stored_view(self, schema_id: str, object_id: str) -> dict[str, Any] | None:
        """As get_view(), from the stored views, as of when they were built or last updated; LookupError if there are none."""
        row = self.views.view(schema_id, [object_id]).first()
        return row.asDict(recursive=True) if row else None

    def get_stats(self) -> dict[str, Any]:
        return materialize.stats(self.log).first().asDict()

    def stats_at(self, timestamp: int) -> dict[str, Any]:
        return timetravel.stats_at(self.log, timestamp).first().asDict()

    def is_negated(self, id: str) -> bool:
        return negation.is_negated(self.log, id)

    # schemas and stored views

    def register_schema(self, id: str, name: str, rules: dict[str, str] | None = None, select: str = "by_target_context", version: int | None = None) -> str:
        """The schema's hash. select is the name of a registered selector; code is never taken as text."""
        schema = HyperSchema(id, name, {role: Rule(target) for role, target in (rules or {}).items()}, select, version)
        self.registry.register(schema, self.config.validate_schemas)
        self.versions.register(schema)
        return schema.hash()

    def load_schema(self, id: str) -> dict[str, Any]:
        found = schemadata.load(self.log, [id]).get(id)
        if found is None:
            raise LookupError(f"Schema not found: {id}")
        self.registry[id] = found
        self.versions.register(found)
        self._snapshots[id] = found.hash()
        return {"id": found.id, "name": found.name, "hash": found.hash(), "schema": json.loads(schemadata.to_json(found))}

    def load_all_schemas(self) -> list[dict[str, Any]]:
        return [self.load_schema(id) for id in schemadata.load(self.log)]

    def schema_changed(self, id: str) -> bool:
        """Whether the log's schema differs from the one loaded; loads nothing."""
        found = schemadata.load(self.log, [id]).get(id)
        return (found.hash() if found else None) != self._snapshots.get(id)

    def reload_schema(self, id: str) -> bool:
        """Loads the schema if it changed; whether it did."""
        changed = self.schema_changed(id)
        if changed:
            self.load_schema(id)
        return changed

    def materialize_view(self, schema_id: str) -> int:
        """Stores the views of all objects; how many rows."""
        return self.views.materialize(self.log, schema_id).count()

    def rebuild_view(self, schema_id: str) -> int:
        return self.views.rebuild(self.log, schema_id).count()


def encode_message(message: dict[str, Any]) -> str:
    return json.dumps(message)


def decode_message(text: str) -> dict[str, Any]:
    message = json.loads(text)
    if not isinstance(message, dict) or not all(message.get(f) for f in MESSAGE_FIELDS):
        raise ValueError("a message has a type and a timestamp")
    return message


def valid_messages(lines: DataFrame) -> DataFrame:
    """Of JSON lines (column value) those that are messages, with type and timestamp."""
    v = F.try_parse_json("value")
    parts = lines.select("value", F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.timestamp", "long").alias("timestamp"))
    return parts.where("length(type) > 0 AND timestamp <> 0")
