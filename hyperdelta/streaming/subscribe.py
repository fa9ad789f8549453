"""Subscriptions as Structured Streaming queries, and what a bounded buffer keeps of a burst.

A stream that stops and starts again from its checkpoint loses nothing, which is how a subscription pauses.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checkpoints import cut
from ..model import COLUMNS, DELTA, as_json
from ..operators.filters import DeltaFilter
from ..operators.materialize import Views
from ..sources.log import DeltaLog

OVERFLOW = ("drop_oldest", "drop_newest", "error", "block")


@dataclass(frozen=True)
class Buffer:
    """How much a consumer takes at once, what happens beyond, and from which percentage on it is warned."""

    capacity: int = 1000
    overflow: str = "drop_oldest"
    warn_percent: int = 80


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log's folder as a stream: what is there first, then what arrives."""
    reader = spark.readStream.schema(DELTA).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def distinct(stream: DataFrame, hours: int = 24) -> DataFrame:
    """Without deltas whose id came before within some hours of event time, so a replayed feed changes nothing."""
    timed = stream.withColumn("_at", F.timestamp_millis("timestamp")).withWatermark("_at", f"{hours} hours")
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_at")


def matching(stream: DataFrame, where: DeltaFilter) -> DataFrame:
    """The filter on a stream. Retractions are deltas like others here, as deltas are judged on arrival."""
    return stream.where(where.condition())


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, where: DeltaFilter = DeltaFilter(), once: bool = True) -> StreamingQuery:
    """Calls the handler with each micro-batch of matching deltas, at least once each. once: stops when all there is has been handled."""
    writer = matching(stream, where).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_feed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Matching deltas as files of JSON lines, pointers as they are."""
    out = stream.select("id", "timestamp", "author", "system", F.to_json("pointers").alias("pointers"))
    return out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(stream: DataFrame, views: Views, schema_id: str, read: Callable[[], DeltaLog], checkpoint: str) -> StreamingQuery:
    """Keeps stored views up to date: each micro-batch rebuilds the views that its deltas affect."""

    def handle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            views.update(read(), schema_id, batch.select("id"))

    return subscribe(stream, handle, checkpoint)


class Bounded:
    """A live consumer that is slower than its stream: micro-batches go into a buffer of `capacity` deltas, and the handler takes them
    from it, one after another, at its own pace.

    offer() is a handler for subscribe(). What does not fit is dropped by the buffer's rule, refused (OverflowError), or, with 'block',
    waits: offer() then does not return, so the stream's next batch is not read. A batch comes to the driver row by row and only as far
    as the buffer has room for it. A delta whose handler fails is counted, goes to on_error and is not tried again; the others go on.
    """

    def __init__(self, handler: Callable[[dict[str, Any]], None], buffer: Buffer = Buffer(), on_error: Callable[[dict[str, Any], Exception], None] | None = None, on_warning: Callable[[int], None] | None = None) -> None:
        if buffer.overflow not in OVERFLOW:
            raise ValueError(f"overflow {buffer.overflow!r}")
        self.handler, self.buffer, self.on_error, self.on_warning = handler, buffer, on_error, on_warning
        self.received = self.processed = self.dropped = self.failed = self.warnings = 0
        self._held: deque[dict[str, Any]] = deque()
        self._changed = threading.Condition()
        self._paused = self._closed = self._busy = False
        self._worker = threading.Thread(target=self._work, daemon=True)
        self._worker.start()

    def offer(self, batch: DataFrame, _: int = 0) -> None:
        for row in batch.select(*COLUMNS).orderBy("seq").toLocalIterator():
            self.put(as_json(row))

    def put(self, delta: dict[str, Any]) -> None:
        with self._changed:
            self.received += 1
            while self.buffer.overflow == "block" and len(self._held) >= self.buffer.capacity and not self._closed:
                self._changed.wait()
            if self._closed:
                raise RuntimeError("the subscription is closed")
            if len(self._held) >= self.buffer.capacity:
                if self.buffer.overflow == "error":
                    raise OverflowError(f"a buffer of {self.buffer.capacity} is full")
                self.dropped += 1
                if self.buffer.overflow == "drop_newest":
                    return
                self._held.popleft()
            self._held.append(delta)
            percent = 100 * len(self._held) // max(1, self.buffer.capacity)
            warn = percent >= self.buffer.warn_percent
            self.warnings += warn
            self._changed.notify_all()
        if warn and self.on_warning:
            self.on_warning(percent)

    def _work(self) -> None:
        while True:
            with self._changed:
                while not self._closed and (self._paused or not self._held):
                    self._changed.wait()
                if self._closed:
                    return
                delta, self._busy = self._held.popleft(), True
                self._changed.notify_all()
            try:
                self.handler(delta)
                self.processed += 1
            except Exception as e:  # the subscriber's own; the subscription outlives it
                self.failed += 1
                if self.on_error:
                    self.on_error(delta, e)
            finally:
                with self._changed:
                    self._busy = False
                    self._changed.notify_all()

    def pause(self) -> None:
        with self._changed:
            self._paused = True

    def resume(self) -> None:
        with self._changed:
            self._paused = False
            self._changed.notify_all()

    def drain(self, seconds: float | None = None) -> bool:
        """Waits until the buffer is empty and the handler idle; whether it came to that in time."""
        with self._changed:
            return self._changed.wait_for(lambda: not self._held and not self._busy, seconds)

    def close(self) -> None:
        """Stops; what is still in the buffer is not handled."""
        with self._changed:
            self._closed = True
            self._changed.notify_all()
        if threading.current_thread() is not self._worker:
            self._worker.join()

    def stats(self) -> dict[str, int]:
        with self._changed:
            return {"received": self.received, "processed": self.processed, "dropped": self.dropped, "failed": self.failed, "warnings": self.warnings, "size": len(self._held), "capacity": self.buffer.capacity}


def _ranked(burst: DataFrame) -> tuple[DataFrame, int]:
    """The burst with each delta's place in it, from 1, and how many there are. Numbered by ranges of seq, in parallel."""
    ranged = cut(burst.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    bases = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("seq")) + F.col("_base")
    return ranged.join(bases, "_part").withColumn("place", place).drop("_part", "_base"), ranged.count()


def kept(burst: DataFrame, buffer: Buffer = Buffer()) -> DataFrame:
    """What a paused consumer's buffer holds after a burst, in the order of seq: the last `capacity` deltas, the first, or all."""
    if buffer.overflow not in OVERFLOW:
        raise ValueError(f"overflow {buffer.overflow!r}")
    if buffer.overflow == "block":
        return burst.select(*COLUMNS)
    rows, n = _ranked(burst)
    if buffer.overflow == "error" and n > buffer.capacity:
        raise OverflowError(f"{n} deltas for a buffer of {buffer.capacity}")
    keep = F.col("place") <= buffer.capacity if buffer.overflow != "drop_oldest" else F.col("place") > n - buffer.capacity
    return rows.where(keep).select(*COLUMNS)


def buffer_stats(burst: DataFrame, buffer: Buffer = Buffer()) -> DataFrame:
    """One row: received, size, capacity, percent_full, dropped, overflowed and warnings after a burst to a paused consumer.

    Each arrival that leaves the buffer at the warning percentage or above warns, unless it overflows.
    """
    n, c = F.count(F.lit(1)), buffer.capacity
    beyond = F.greatest(n - c, F.lit(0))
    drops = buffer.overflow in ("drop_oldest", "drop_newest")
    size = n if buffer.overflow == "block" else F.least(n, F.lit(c))
    first_warned = -(-c * buffer.warn_percent // 100)
    warned = F.greatest((n if buffer.overflow == "block" else F.least(n, F.lit(c))) - F.lit(max(1, first_warned) - 1), F.lit(0))
    overflowed = F.lit(0) if buffer.overflow == "block" else F.least(beyond, F.lit(1)) if buffer.overflow == "error" else beyond
    return burst.agg(
        n.alias("received"), size.cast("long").alias("size"), F.lit(c).cast("long").alias("capacity"), F.round(100.0 * size / c, 6).alias("percent_full"),
        (beyond if drops else F.lit(0)).cast("long").alias("dropped"), overflowed.cast("long").alias("overflowed"), warned.cast("long").alias("warnings"),
    )
