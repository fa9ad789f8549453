"""Schemas kept in the log: their names, selectors and rules are deltas on the schema's id, so they can be added, superseded and retracted."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pointers as P
from ..model import Target, ref
from ..operators.hyperview import long_form
from ..operators.negation import live
from ..sources.log import DeltaLog
from .schema import HyperSchema, Registry, Rule

SYSTEM_AUTHOR = "system"


def terminal(schema_id: str, name: str, selector: str = "by_target_context") -> list[list[tuple[str, Target]]]:
    """Pointers of the deltas that make a schema without rules: its name, its selector and an empty set of rules."""
    return [
        [("schema", ref(schema_id, "name")), ("name", name)],
        [("schema", ref(schema_id, "select")), ("pattern", ref(selector))],
        [("schema", ref(schema_id, "transform")), ("rules", "{}")],
    ]


def rule(schema_id: str, role: str, opens: str) -> list[tuple[str, Target]]:
    """Pointers of the delta that adds a rule: pointers with the role open into another schema."""
    return [("schema", ref(schema_id, "transform")), ("on-context", role), ("apply-schema", ref(opens))]


def schema_ids(log: DeltaLog) -> DataFrame:
    """(schema_id) that live deltas define: the first reference in a role `schema` of each."""
    first = P.first("schema")
    return live(log).deltas.select(first.alias("p")).where("p.kind = 'ref'").select(F.col("p.ref_id").alias("schema_id")).distinct()


def rules_table(log: DeltaLog, asof: int | None = None) -> DataFrame:
    """(schema_id, role, target) of all live rules; a later rule for a role supersedes an earlier one.

    Rules come as single deltas, or as an object {role: schema} in JSON.
    """
    rows = long_form(log, None, asof).where("property = 'transform'").select(F.col("object_id").alias("schema_id"), "timestamp", "seq", "pointers")
    single = rows.select("schema_id", "timestamp", "seq", P.primitive("on-context").alias("role"), P.primitive("apply-schema").alias("target")).where("role IS NOT NULL AND target IS NOT NULL")
    packed = rows.select("schema_id", "timestamp", "seq", F.explode(F.from_json(P.primitive("rules"), "map<string,string>")).alias("role", "target"))
    last = F.max_by("target", F.struct("timestamp", "seq")).alias("target")
    return single.unionAll(packed).groupBy("schema_id", "role").agg(last)


def dependents(rules: DataFrame, schema_id: str) -> DataFrame:
    """(schema_id) with a rule that leads to a schema, itself left out."""
    return rules.where((F.col("target") == schema_id) & (F.col("schema_id") != schema_id)).select("schema_id").distinct()


def load(log: DeltaLog, ids: Iterable[str] | None = None, asof: int | None = None) -> dict[str, HyperSchema]:
    """Schemas built from the log, all or some. The most recent name counts; a schema without one is named by its id.

    Schemas are few; what defines them comes to the driver.
    """
    roots = None if ids is None else list(ids)
    own = long_form(log, roots, asof).where(F.col("property").isin("name", "select"))
    latest = F.max_by(F.struct(P.primitive("name").alias("name"), P.reference("pattern").alias("pattern")), F.struct("timestamp", -F.col("seq"))).alias("d")
    facts: dict[str, dict[str, str]] = {}
    for r in own.where(F.exists("pointers", lambda p: p["role"] == "schema")).groupBy("object_id", "property").agg(latest).collect():
        facts.setdefault(r["object_id"], {})[r["property"]] = r["d"]["name" if r["property"] == "name" else "pattern"]
    rules: dict[str, dict[str, Rule]] = {}
    for r in rules_table(log, asof).collect():
        if roots is None or r["schema_id"] in roots:
            rules.setdefault(r["schema_id"], {})[r["role"]] = Rule(r["target"])
    return {
        id: HyperSchema(id, facts.get(id, {}).get("name") or id, dict(sorted(rules.get(id, {}).items())), facts.get(id, {}).get("select") or "by_target_context")
        for id in sorted({*facts, *rules})
    }


class Catalog:
    """A registry that follows the log: what code registers wins over what the log says."""

    def __init__(self, log: DeltaLog, code: Iterable[HyperSchema] = ()) -> None:
        self.registry, self._code, self._hashes = Registry(), {s.id: s for s in code}, {}
        self.refresh(log)

    def changed(self, log: DeltaLog, id: str) -> bool:
        """Whether the log says otherwise than when it was last read. Nothing is reloaded."""
        now = load(log, [id]).get(id)
        return (now.hash() if now else None) != self._hashes.get(id)

    def refresh(self, log: DeltaLog) -> list[str]:
        """Reads all schemas again; the ids of those that changed."""
        found = load(log)
        hashes = {id: s.hash() for id, s in found.items()}
        differ = sorted(id for id in {*hashes, *self._hashes} if hashes.get(id) != self._hashes.get(id))
        self._hashes = hashes
        self.registry.clear()
        self.registry.update({**found, **self._code})
        return differ


def to_json(schema: HyperSchema) -> str:
    return json.dumps({"id": schema.id, "name": schema.name, "select": schema.selector, "transform": {r: x.schema for r, x in schema.rules.items()}}, sort_keys=True)
