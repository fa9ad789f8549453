"""What several training-data operators share: checkpoints, Arrow batches, words and n-gram hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker gets at once. Spark also ends a batch at spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_ROWS = 2000

U64 = np.uint64
P1, P2, P3, P4, P5 = (
    U64(11400714785074694791),
    U64(14029467366897019727),
    U64(1609587929392839161),
    U64(9650029242287828579),
    U64(2870177450012600261),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The shared folder for checkpoints is the session's own; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(shared)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so a lost executor costs nothing downstream."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def mapped(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """XXH64 (seed 42) of words, as signed 64-bit numbers; Spark's xxhash64 gives the same. Emptied when it grows large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(U64)


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def hash_long(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of one 64-bit number, element-wise: xxhash64(a, b) of Spark is hash_long(b, hash_long(a, 42))."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=U64) + P5 + U64(8)
        h = h ^ (rotl(value.astype(U64, copy=False) * P2, 31) * P1)
        h = rotl(h, 27) * P1 + P4
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths start; one more for the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + length - 1, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = starts_of(lengths)[:-1]
    return np.repeat(starts - at, lengths) + np.arange(total)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; it goes with the run's checkpoints."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of stage_path() that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def runs(contents: list[bytes] | list[str], most: int = 8 << 20) -> Iterator[slice]:
    """Slices of texts of about `most` bytes (or characters) together, or of one longer text, so that a batch's arrays stay small."""
    first = held = 0
    for i, text in enumerate(contents):
        if held and held + len(text) > most:
            yield slice(first, i)
            first, held = i, 0
        held += len(text)
    if first < len(contents):
        yield slice(first, len(contents))
