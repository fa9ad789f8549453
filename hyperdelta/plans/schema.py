"""Schemas of object views: which deltas show on an object, and which of their pointers open into views of other objects."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pointers import PRIMITIVES

DEFAULT_PROPERTY = "_default"

#: Named selectors. One gets the object's id and the delta's columns, and gives the properties (array of strings) under which the
#: delta shows; null or none leaves it out. They see the deltas that refer to the object.
SELECTORS: dict[str, Callable[[Column], Column]] = {
    "by_target_context": lambda object_id: F.transform(
        F.filter("pointers", lambda p: (p["ref_id"] == object_id) & p["ref_context"].isNotNull()), lambda p: p["ref_context"]
    ),
    "everything": lambda object_id: F.array(F.lit(DEFAULT_PROPERTY)),
    "by_role": lambda object_id: F.transform(F.filter("pointers", lambda p: p["ref_id"] == object_id), lambda p: p["role"]),
}


def register_selector(name: str, build: Callable[[Column], Column]) -> None:
    SELECTORS[name] = build


@dataclass(frozen=True)
class Rule:
    """What a pointer with the role opens into: a schema's id, or the name of a primitive type. when: SQL over the delta's
    columns and the pointer `p`; by default the pointer need only be a reference."""

    schema: str
    when: str | None = None

    @property
    def primitive(self) -> bool:
        return self.schema in PRIMITIVES


@dataclass(frozen=True)
class HyperSchema:
    id: str
    name: str
    rules: dict[str, Rule] = field(default_factory=dict)
    selector: str = "by_target_context"
    version: int | None = None
    properties: tuple[str, ...] | None = None  # the only ones that its views show; None for all

    @property
    def nested(self) -> dict[str, Rule]:
        return {role: r for role, r in self.rules.items() if not r.primitive}

    def hash(self) -> str:
        """Of what the schema means: alike however its rules are ordered."""
        rules = {role: [r.schema, r.when] for role, r in sorted(self.rules.items())}
        text = json.dumps({"id": self.id, "name": self.name, "select": self.selector, "transform": rules, "properties": self.properties}, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()


class SchemaError(ValueError):
    pass


class CircularSchema(SchemaError):
    def __init__(self, cycle: list[str]) -> None:
        super().__init__("circular schemas: " + " -> ".join(cycle))
        self.cycle = cycle


class Registry(dict[str, HyperSchema]):
    """Schemas by id. References are resolved when a view is built, so they may be registered in any order."""

    def register(self, schema: HyperSchema, validate: bool = False) -> HyperSchema:
        if validate:
            check(schema, self)
        self[schema.id] = schema
        return schema

    def resolve(self, schema: HyperSchema | str) -> HyperSchema:
        if isinstance(schema, HyperSchema):
            return self.setdefault(schema.id, schema)
        if schema not in self:
            raise SchemaError(f"Schema not found: {schema}")
        return self[schema]


@dataclass(frozen=True)
class Report:
    errors: tuple[str, ...]
    dependencies: tuple[str, ...]
    depth: int

    @property
    def valid(self) -> bool:
        return not self.errors


def validate(schema: HyperSchema, registry: dict[str, HyperSchema] | None = None) -> Report:
    """Errors of a schema by itself: its id, name, selector, rules, and rules that lead back to itself."""
    errors = [f"Schema must have {what}" for what, ok in (("an id", schema.id), ("a name", schema.name)) if not ok]
    if schema.selector not in SELECTORS:
        errors.append(f"Unknown selector: {schema.selector}")
    for role, rule in schema.rules.items():
        if not rule.schema:
            errors.append(f"Rule for role {role!r} has no schema")
        elif rule.schema == schema.id:
            errors.append(f"Schema {schema.id} references itself in role {role!r}")
    dependencies = tuple(dict.fromkeys(r.schema for r in schema.nested.values()))
    return Report(tuple(errors), dependencies, depth(schema.id, {**(registry or {}), schema.id: schema}))


def cycle(start: str, schemas: dict[str, HyperSchema]) -> list[str] | None:
    """A circle of schema ids that start leads into, first and last alike; schemas that are not there lead nowhere."""
    path: list[str] = []
    done: set[str] = set()
    stack: list[tuple[str, bool]] = [(start, True)]
    while stack:
        id, enter = stack.pop()
        if not enter:
            path.pop()
            done.add(id)
        elif id in path:
            return [*path[path.index(id) :], id]
        elif id in schemas and id not in done:
            path.append(id)
            stack.append((id, False))
            stack += [(r.schema, True) for r in schemas[id].nested.values()]
    return None


def check(schema: HyperSchema, registry: dict[str, HyperSchema]) -> None:
    """Raises if the schema has errors or closes a circle with those registered. The registry stays as it is."""
    report = validate(schema, registry)
    if found := cycle(schema.id, {**registry, schema.id: schema}):
        raise CircularSchema(found)
    if report.errors:
        raise SchemaError("; ".join(report.errors))


def would_create_cycle(schema: HyperSchema, registry: dict[str, HyperSchema]) -> bool:
    return cycle(schema.id, {**registry, schema.id: schema}) is not None


def dependents(id: str, registry: dict[str, HyperSchema]) -> list[str]:
    """Schemas with a rule that leads to it, itself left out."""
    return sorted(s.id for s in registry.values() if s.id != id and any(r.schema == id for r in s.nested.values()))


def depth(id: str, registry: dict[str, HyperSchema]) -> int:
    """Levels of views inside each other: 1 for a schema that opens no other. What leads back counts nothing."""

    if id not in registry:
        return 0
    if cycle(id, registry):  # rare, and wrong: by each path

        def below(id: str, above: frozenset[str]) -> int:
            if id in above or id not in registry:
                return 0
            return 1 + max((below(r.schema, above | {id}) for r in registry[id].nested.values()), default=0)

        return below(id, frozenset())
    levels: dict[str, int] = {}
    for s in topological(registry, [id]):  # each schema once, however many paths lead to it
        levels[s.id] = 1 + max((levels.get(r.schema, 0) for r in s.nested.values()), default=0)
    return levels[id]


def topological(registry: dict[str, HyperSchema], roots: list[str] | None = None) -> list[HyperSchema]:
    """Schemas after those that they open; of all, or of those that the roots lead to."""
    out: dict[str, HyperSchema] = {}

    def visit(id: str) -> None:
        if id not in out and id in registry:
            for r in registry[id].nested.values():
                visit(r.schema)
            out[id] = registry[id]

    for id in roots if roots is not None else list(registry):
        if found := cycle(id, registry):
            raise CircularSchema(found)
        visit(id)
    return list(out.values())


def changed(old: HyperSchema, new: HyperSchema) -> bool:
    """By their versions if both have one, else by their hashes."""
    if old.version is not None and new.version is not None:
        return old.version != new.version
    return old.hash() != new.hash()


class Versions:
    """The versions that were registered of each schema, the last of them current."""

    def __init__(self) -> None:
        self._all: dict[str, list[tuple[str, int | None]]] = {}

    def register(self, schema: HyperSchema) -> None:
        mark, known = (schema.hash(), schema.version), self._all.setdefault(schema.id, [])
        if mark not in known:
            known.append(mark)

    def history(self, id: str) -> list[tuple[str, int | None]]:
        return list(self._all.get(id, []))

    def latest(self, id: str) -> tuple[str, int | None] | None:
        return (self._all.get(id) or [None])[-1]

    def table(self, spark: SparkSession) -> DataFrame:
        """(schema_id, place, hash, version) of all, to be stored."""
        rows = [(id, i, hash, version) for id, known in self._all.items() for i, (hash, version) in enumerate(known)]
        return spark.createDataFrame(rows, "schema_id string, place int, hash string, version int")

    @classmethod
    def of(cls, table: DataFrame) -> Versions:
        """Those of a stored table, a row a version of a schema."""
        out = cls()
        for r in table.orderBy("schema_id", "place").collect():
            out._all.setdefault(r["schema_id"], []).append((r["hash"], r["version"]))
        return out

    def outdated(self, id: str, hash: str, version: int | None = None) -> bool:
        """Whether something made by that hash or version is behind the current one. What was never registered is not."""
        current = self.latest(id)
        if current is None:
            return False
        if version is not None and current[1] is not None:
            return version < current[1]
        return hash != current[0]
