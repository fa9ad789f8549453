"""Stored views with the schema they were built by, and upkeep that rebuilds only what new deltas touch."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..model import frame
from ..plans.schema import HyperSchema, Registry, Versions, depth
from ..sources.log import DeltaLog
from .hyperview import Roots, long_form, nested_long, packed


def metadata(log: DeltaLog, schema: HyperSchema, roots: Roots = None, asof: int | None = None) -> DataFrame:
    """(object_id, delta_count, last_updated, schema_id, schema_hash, schema_version) of each object's view.

    last_updated is the time of the latest delta in the view; high_seq the last that had arrived.
    """
    rows = long_form(log, roots, asof, selector=schema.selector).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("delta_count"), F.max("timestamp").alias("last_updated"), F.max("seq").alias("high_seq")
    )
    return rows.withColumns({"schema_id": F.lit(schema.id), "schema_hash": F.lit(schema.hash()), "schema_version": F.lit(schema.version).cast("int")})


def outdated(stored: DataFrame, versions: Versions) -> DataFrame:
    """(object_id, schema_id) of stored views made by another form of their schema than the current one."""
    spark = stored.sparkSession
    known = [(id, *versions.latest(id)) for id in versions._all]
    current = F.broadcast(spark.createDataFrame(known, "schema_id string, _hash string, _version int"))  # a row a schema
    rows = stored.join(current, "schema_id")
    newer = F.when(F.col("schema_version").isNotNull() & F.col("_version").isNotNull(), F.col("schema_version") < F.col("_version")).otherwise(F.col("schema_hash") != F.col("_hash"))
    return rows.where(newer).select("object_id", "schema_id")


def affected(log: DeltaLog, fresh: DataFrame, levels: int = 1) -> DataFrame:
    """(object_id) whose views new deltas (by their ids) change.

    These are the objects that they refer to, the objects of deltas that they retract or bring back, however long the chain,
    and, for each further level of nesting, the objects with a delta that refers to one of these.
    """
    new = log.deltas.join(fresh.select("id"), "id", "left_semi")
    touched = new
    edges = log.negations.select(F.col("negator_id").alias("id"), "target_id")
    layer = cut(new.select("id"))
    while True:
        layer = cut(edges.join(layer, "id", "left_semi").select(F.col("target_id").alias("id")).distinct())
        if layer.isEmpty():
            break
        touched = touched.unionAll(log.deltas.join(layer, "id", "left_semi"))
    objects = DeltaLog(touched).references.where("property IS NOT NULL").select("object_id").distinct()
    refs = log.references
    pairs = refs.where("property IS NOT NULL").select(F.col("object_id").alias("owner"), "id").join(refs.select("id", F.col("object_id").alias("target")), "id").where("owner <> target")
    layer = objects
    for _ in range(levels - 1):
        layer = pairs.join(layer.withColumnRenamed("object_id", "target"), "target", "left_semi").select(F.col("owner").alias("object_id")).distinct()
        objects = objects.unionAll(layer).distinct()
    return objects


#: Folders that a schema's stored views are dealt to, by object. Upkeep writes anew those of the objects that it touches.
BUCKETS = 64


class Views:
    """Stored views: for each schema the long form with opened pointers and metadata columns, in Parquet by bucket of the object.

    Nothing is kept in memory. Each write puts the buckets that it changes into a new generation's folder, and then a commit, a small
    file that says in which generation each bucket is; the latest commit counts. So a reader sees one state or the next, a write that
    fails leaves nothing behind that is read, of two writers at once one fails, and another session goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str, registry: Registry, versions: Versions) -> None:
        self.spark, self.path, self.registry, self.versions = spark, path, registry, versions

    # files

    def _fs(self, below: str) -> tuple[Any, Any]:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _commits(self, id: str) -> list[int]:
        fs, path = self._fs(f"{id}/_commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _state(self, id: str) -> tuple[int, dict[str, int]]:
        """The latest commit's number, and the generation of each bucket."""
        commits = self._commits(id)
        if not commits:
            raise LookupError(f"No materialized view found for schema {id}")
        fs, path = self._fs(f"{id}/_commits/{commits[-1]:010d}")
        stream = fs.open(path)
        try:
            return commits[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, id: str, number: int, buckets: dict[str, int]) -> None:
        fs, path = self._fs(f"{id}/_commits/{number:010d}")
        stream = fs.create(path, False)  # fails if another writer has been here
        stream.write(bytearray(json.dumps(buckets).encode()))
        stream.close()

    # views

    def materialize(self, log: DeltaLog, schema: HyperSchema | str) -> DataFrame:
        """Builds and stores the views of all objects; their counts."""
        s = self.registry.resolve(schema)
        self.versions.register(s)
        commits = self._commits(s.id)
        number = commits[-1] + 1 if commits else 1
        self._commit(s.id, number, dict.fromkeys(self._write(s, number, self._rows(log, s, None)), number))
        return self.get(s.id)

    def _rows(self, log: DeltaLog, s: HyperSchema, roots: Roots) -> DataFrame:
        long = nested_long(log, s, self.registry, roots)
        return long.withColumns({"schema_id": F.lit(s.id), "schema_hash": F.lit(s.hash()), "schema_version": F.lit(s.version).cast("int"), "bucket": _bucket()})

    def _write(self, s: HyperSchema, number: int, rows: DataFrame) -> list[str]:
        """The buckets that rows went to."""
        # an object with many referrers is dealt out by delta as well
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "object_id", "property", "seq")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{s.id}/generation={number}")
        fs, path = self._fs(f"{s.id}/generation={number}")
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]

    def rows(self, id: str, objects: list[str] | None = None) -> DataFrame:
        """The stored long form with opened pointers, of all objects, or of some by reading their buckets alone."""
        _, buckets = self._state(id)
        if objects is not None:
            of = self.spark.createDataFrame([(o,) for o in objects], "object_id string").select(_bucket().alias("b")).distinct()
            wanted = {str(r["b"]) for r in of.collect()}  # at most BUCKETS rows
            buckets = {b: g for b, g in buckets.items() if b in wanted}
        root = f"{self.path}/{id}"
        if not buckets:  # of a log without a delta that shows
            s = self.registry.resolve(id)
            return self._rows(DeltaLog(frame(self.spark, [])), s, None).drop("bucket")
        out = self.spark.read.parquet(*(f"{root}/generation={g}/bucket={b}" for b, g in sorted(buckets.items())))
        return out if objects is None else out.where(F.col("object_id").isin(objects))

    def get(self, id: str) -> DataFrame:
        """(object_id, property, n) of the stored views and metadata columns."""
        return self.rows(id).groupBy("object_id", "property", "schema_id", "schema_hash", "schema_version").agg(F.count(F.lit(1)).alias("n"))

    def view(self, id: str, objects: list[str]) -> DataFrame:
        """(object_id, props) of some stored views, as nested() gives them."""
        return packed(self.rows(id, objects))

    def rebuild(self, log: DeltaLog, id: str) -> DataFrame:
        self._state(id)
        return self.materialize(log, id)

    def update(self, log: DeltaLog, id: str, fresh: DataFrame) -> DataFrame:
        """The stored views, with those that the new deltas affect built anew, objects that open them included, however deep. Buckets
        without such an object stay as they are."""
        s, (number, buckets) = self.registry.resolve(id), self._state(id)
        roots = cut(affected(log, fresh, depth(s.id, self.registry)))
        touched = {str(r["b"]) for r in roots.select(_bucket().alias("b")).distinct().collect()}  # at most BUCKETS rows
        rows = self._rows(log, s, roots)
        old = [f"{self.path}/{id}/generation={g}/bucket={b}" for b, g in sorted(buckets.items()) if b in touched]
        if old:
            stored = self.spark.read.parquet(*old).join(roots, "object_id", "left_anti").withColumn("bucket", _bucket())
            rows = rows.unionByName(stored)
        written = self._write(s, number + 1, rows) if touched else []
        self._commit(id, number + 1, {b: g for b, g in buckets.items() if b not in touched} | dict.fromkeys(written, number + 1))
        return self.get(id)

    def is_outdated(self, id: str) -> bool:
        """Whether the schema is gone or has changed since; new deltas do not count."""
        if id not in self.registry:
            return True
        self.versions.register(self.registry[id])
        return not outdated(self.get(id), self.versions).isEmpty()

    def invalidate(self, id: str) -> None:
        """Forgets the stored views: there are none until they are built again. Files that a reader may be at stay until vacuum()."""
        commits = self._commits(id)
        for n in commits:
            fs, path = self._fs(f"{id}/_commits/{n:010d}")
            fs.delete(path, False)

    def vacuum(self, id: str) -> list[int]:
        """Deletes the generations that the latest commit does not name; which."""
        commits = self._commits(id)
        named = set(self._state(id)[1].values()) if commits else set()
        fs, path = self._fs(id)
        found = [int(n.removeprefix("generation=")) for n in (f.getPath().getName() for f in fs.listStatus(path)) if n.startswith("generation=")] if fs.exists(path) else []
        gone = sorted(set(found) - named)
        for g in gone:
            fs.delete(self._fs(f"{id}/generation={g}")[1], True)
        return gone


def _bucket() -> Column:
    return F.pmod(F.xxhash64("object_id"), F.lit(BUCKETS)).cast("int")


def stats(log: DeltaLog) -> DataFrame:
    """One row: total deltas, the latest time, how many objects, authors and systems."""
    own = log.deltas.agg(F.count(F.lit(1)).alias("total"), F.max("timestamp").alias("latest"), F.countDistinct("author").alias("authors"), F.countDistinct("system").alias("systems"), F.lit(1).alias("one"))
    return own.join(log.references.agg(F.countDistinct("object_id").alias("objects"), F.lit(1).alias("one")), "one").drop("one")
