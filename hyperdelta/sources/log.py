"""The log as a DataFrame, and as a Parquet dataset that is only ever appended to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import pointers as P
from ..model import COLUMNS, DELTA, NEGATES, POINTER

DAY = 86_400_000


@dataclass(frozen=True)
class DeltaLog:
    """deltas has the columns of model.DELTA. Ids are taken to be unique; deduplicated() makes them so."""

    deltas: DataFrame

    @cached_property
    def edges(self) -> DataFrame:
        """A row for each pointer: the delta's columns, then the pointer's."""
        return self.deltas.select(F.col("id").alias("delta_id"), "timestamp", "author", "system", "seq", F.inline("pointers"))

    @cached_property
    def references(self) -> DataFrame:
        """A row for each reference: (object_id, property, pos, and the delta with all its pointers); property may be null."""
        own = self.deltas.columns
        flat = self.deltas.select(*own, F.inline("pointers").alias(*(f"_{c}" for c in POINTER.names))).where("_kind = 'ref'")
        return flat.select(*own, F.col("_pos").alias("pos"), F.col("_ref_id").alias("object_id"), F.col("_ref_context").alias("property"))

    @cached_property
    def negations(self) -> DataFrame:
        """(negator_id, target_id, timestamp, seq, author) of each retraction."""
        hits = F.filter("pointers", lambda p: (p["role"] == NEGATES) & (p["kind"] == "ref"))
        some = self.deltas.where(F.array_contains(F.col("pointers.role"), NEGATES))  # cheap, and most have none
        targets = some.select("id", "timestamp", "seq", "author", F.explode(F.transform(hits, lambda p: p["ref_id"])).alias("target_id"))
        return targets.select(F.col("id").alias("negator_id"), "target_id", "timestamp", "seq", "author")

    def deduplicated(self) -> DeltaLog:
        """One row an id: the first that arrived. Persisting a delta again changes nothing."""
        first = F.min_by(F.struct(*COLUMNS), F.col("seq")).alias("d")
        return DeltaLog(self.deltas.groupBy("id").agg(first).select("d.*"))

    def until(self, asof: int | None) -> DeltaLog:
        """The log as it was at a time, in ms."""
        return self if asof is None else DeltaLog(self.deltas.where(F.col("timestamp") <= asof))

    def between(self, start: int | None, end: int | None) -> DeltaLog:
        """The log of a range of time, both ends included."""
        rows = self.deltas
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                rows = rows.where(getattr(F.col("timestamp"), op)(bound))
        return DeltaLog(rows)

    def valid(self) -> DeltaLog:
        return DeltaLog(self.deltas.where(P.error().isNull()))

    def quarantine(self) -> DataFrame:
        """The deltas that break a rule, with it as `error`."""
        return self.deltas.withColumn("error", P.error()).where("error IS NOT NULL")


@dataclass(frozen=True)
class StoredLog(DeltaLog):
    """A store's log, up to a time if it has one. Ranges of time read only the day folders that they touch."""

    store: Store | None = None
    end: int | None = None

    def until(self, asof: int | None) -> DeltaLog:
        end = asof if self.end is None else self.end if asof is None else min(asof, self.end)
        return self if end == self.end else StoredLog(self.store.read(end=end), self.store, end)

    def between(self, start: int | None, end: int | None) -> DeltaLog:
        ends = [x for x in (end, self.end) if x is not None]
        return DeltaLog(self.store.read(start, min(ends) if ends else None))


#: What the store's index is by: kind, and the column of the index's rows that comes from the deltas.
INDEXED = ("target", "context", "author", "system")
#: Folders that an index's keys are dealt to. A look-up reads those of its keys.
BUCKETS = 64


class Store:
    """A log on storage: Parquet files by day, sorted by time. Nothing is kept open; the path is the store.

    Beside it, in `_index`, a row (kind, key, id, day, timestamp) for each target, property, author and system of each delta, in folders
    by kind and by the key's bucket, sorted by key: a look-up reads its keys' buckets and then only the days that they name. The index
    is written before the deltas, so it may name deltas that are not there, which a look-up does not find, but it misses none.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self, below: str = "") -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path + below)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def log(self) -> StoredLog:
        return StoredLog(self.read(), self)

    def read(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """The deltas, of a range of time if given, both ends included. The range also selects day folders, which a condition on timestamp alone would not."""
        if not self._exists():
            return self.spark.createDataFrame([], DELTA)
        df = self._rows()
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                df = df.where(getattr(F.col("day"), op)(bound // DAY)).where(getattr(F.col("timestamp"), op)(bound))
        return df.select(*COLUMNS)

    def _rows(self) -> DataFrame:
        """The deltas with their day."""
        return self.spark.read.schema("id string, timestamp long, author string, system string, seq long, pointers " + DELTA["pointers"].dataType.simpleString() + ", day int").parquet(self.path)

    def append(self, deltas: DataFrame) -> None:
        """Adds valid deltas that are not there yet, in one batch; an invalid one refuses the batch. seq continues the store's."""
        wrong = deltas.withColumn("error", P.error()).where("error IS NOT NULL").select("id", "error").first()
        if wrong:
            raise ValueError(f"delta {wrong['id']!r}: {wrong['error']}")
        held = self.read()
        base = held.agg(F.max("seq")).first()[0]
        fresh = DeltaLog(deltas).deduplicated().deltas.join(held.select("id"), "id", "left_anti")
        numbered = self._numbered(fresh, 0 if base is None else base + 1)
        day = F.floor(F.col("timestamp") / DAY).cast("int").alias("day")
        numbered = cut(numbered.select(*COLUMNS, day))
        self._index(numbered)
        out = numbered.repartition("day", F.pmod(F.xxhash64("id"), F.lit(64)))
        out.sortWithinPartitions("day", "timestamp", "id").write.mode("append").partitionBy("day").parquet(self.path)

    def _index(self, deltas: DataFrame) -> None:
        refs = F.filter("pointers", lambda p: p["kind"] == "ref")
        keys = (F.transform(refs, lambda p: p["ref_id"]), F.transform(refs, lambda p: p["ref_context"]), F.array("author"), F.array("system"))

        def entry(kind: str) -> Callable[[Column], Column]:
            return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))

        entries = F.flatten(F.array(*(F.transform(F.array_distinct(k), entry(kind)) for kind, k in zip(INDEXED, keys))))
        rows = deltas.select(F.inline(entries), "id", "day", "timestamp").where("key IS NOT NULL").withColumn("bucket", _bucket(F.col("key")))
        # a frequent key's rows are dealt out by id as well, so no task gets them all
        out = rows.repartition("kind", "bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("kind", "bucket", "key", "timestamp", "id")
        out.write.mode("append").partitionBy("kind", "bucket").parquet(f"{self.path}/_index")

    def entries(self, kind: str, keys: list[str]) -> DataFrame:
        """(key, id, day, timestamp) of the index for some targets, contexts, authors or systems."""
        if kind not in INDEXED:
            raise ValueError(f"no index by {kind!r}")
        schema = "key string, id string, day int, timestamp long, kind string, bucket int"
        if not keys or not self._exists("/_index"):
            return self.spark.createDataFrame([], schema).drop("kind", "bucket")
        of = self.spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket(F.col("key")).alias("b")).distinct()
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/_index").where(F.col("kind") == kind).where(F.col("bucket").isin([r["b"] for r in of.collect()]))  # at most BUCKETS rows
        return rows.where(F.col("key").isin(keys)).drop("kind", "bucket")

    def find(self, start: int | None = None, end: int | None = None, **keys: list[str] | None) -> DataFrame:
        """The deltas that have one of the keys of each given kind (target, context, author, system), found by the index: only the days
        that it names are read."""
        hits: DataFrame | None = None
        for kind, wanted in keys.items():
            if wanted is not None:
                own = self.entries(kind, wanted)
                for bound, op in ((start, "__ge__"), (end, "__le__")):
                    own = own if bound is None else own.where(getattr(F.col("timestamp"), op)(bound))
                own = own.select("id", "day").distinct()
                hits = own if hits is None else hits.join(own, ["id", "day"], "left_semi")
        if hits is None:
            return self.read(start, end)
        hits = cut(hits)
        days = [r["day"] for r in hits.select("day").distinct().collect()]  # a row a day
        rows = self._rows().where(F.col("day").isin(days) if days else F.lit(False)) if self._exists() else self.read().withColumn("day", F.lit(0))
        return rows.join(hits, ["id", "day"], "left_semi").select(*COLUMNS)

    def reindex(self) -> None:
        """Writes the index anew from the deltas, as for a store that had none."""
        self._delete("/_index")
        if self._exists():
            self._index(self._rows())

    @staticmethod
    def _numbered(deltas: DataFrame, base: int) -> DataFrame:
        """seq from base on, in the order of the incoming seq. Numbers are dealt by ranges, so no task sees more than its own."""
        ranged = cut(deltas.repartitionByRange("seq", "id").withColumn("_part", F.spark_partition_id()))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
        bases = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("seq", "id"))
        placed = ranged.withColumn("_row", place).join(bases, "_part")
        return placed.withColumn("seq", F.col("_row") + F.col("_base") + (base - 1)).select(*COLUMNS)

    def clear(self) -> None:
        """Drops the log's files; subscriptions and schemas are elsewhere and stay."""
        self._delete("")

    def _delete(self, below: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path + below)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def to_feed(deltas: DataFrame) -> DataFrame:
    """Each delta as a line of JSON (column value); a pointer's target is an object for a reference, else the primitive itself."""

    def line(p):
        ref = F.to_json(F.struct(p["role"].alias("role"), F.struct(p["ref_id"].alias("id"), p["ref_context"].alias("context")).alias("target")))
        whole = F.when((p["num"] == F.floor(p["num"])) & (F.abs(p["num"]) < 1e15), F.to_json(F.struct(p["role"].alias("role"), p["num"].cast("long").alias("target"))))
        other = [F.to_json(F.struct(p["role"].alias("role"), p[k].alias("target"))) for k in ("str", "num", "bool")]
        return F.when(p["kind"] == "ref", ref).when(p["kind"] == "str", other[0]).when(p["kind"] == "num", F.coalesce(whole, other[1])).otherwise(other[2])

    head = F.to_json(F.struct("id", "timestamp", "author", "system"))
    body = F.concat(F.lit(',"pointers":['), F.array_join(F.transform("pointers", line), ","), F.lit("]}"))
    return deltas.select(F.concat(F.regexp_replace(head, r"\}$", ""), body).alias("value"))


def from_feed(lines: DataFrame) -> DataFrame:
    """Deltas from lines of JSON (column value). Kinds come from the JSON values themselves. Lines that are no JSON objects are left out;
    bad_lines() has them. seq rises from line to line, as Spark reads them: one file in its order, several in that of their splits."""
    v = lines.select(F.monotonically_increasing_id().alias("seq"), F.try_parse_json("value").alias("v")).where(_object(F.col("v")))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    raw = v.select(get("$.id", "string").alias("id"), get("$.timestamp", "long").alias("timestamp"), get("$.author", "string").alias("author"), get("$.system", "string").alias("system"), "seq", get("$.pointers", "array<variant>").alias("ps"))

    def read(p, i):
        t = F.try_variant_get(p, "$.target", "variant")
        kind = F.schema_of_variant(t)
        tag = F.when(kind.startswith("OBJECT"), "ref").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").otherwise("num")
        only = lambda k, path, as_: F.when(tag == k, F.try_variant_get(p, path, as_))
        return F.struct(
            i.alias("pos"), F.try_variant_get(p, "$.role", "string").alias("role"), tag.alias("kind"), only("ref", "$.target.id", "string").alias("ref_id"),
            only("ref", "$.target.context", "string").alias("ref_context"), only("str", "$.target", "string").alias("str"), only("num", "$.target", "double").alias("num"), only("bool", "$.target", "boolean").alias("bool"),
        )

    return raw.select("id", "timestamp", "author", "system", "seq", F.transform("ps", read).alias("pointers"))


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def bad_lines(lines: DataFrame) -> DataFrame:
    """(value) of the lines that from_feed() leaves out: null, malformed, or something other than an object."""
    return lines.select("value").where(~_object(F.try_parse_json("value")))
