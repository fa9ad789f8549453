"""Rows that meet by a key, moved between tasks as compressed blocks of columns.

The rows of a log repeat themselves: ids begin alike, an object's deltas hold its id again and again. Row by row an exchange keeps most
of that; a block of some hundred rows, by column and then compressed as a whole, is several times smaller and needs no texts to be made or read.
A key's rows go to one part, and a task takes one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that a task holds before it sends them on as blocks; how hard these are compressed.
HELD = 32_000_000
LEVEL = 4
SCHEMA = "part int, tag int, block binary"
Tables = dict[int, pa.Table]


def part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(rows, sink, compression="none", write_statistics=False)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def read(block: bytes) -> pa.Table:
    raw = pa.decompress(memoryview(block)[8:], int.from_bytes(block[:8], "little"), "zstd")
    return pq.read_table(pa.BufferReader(raw), use_threads=False)


def sent(parts: np.ndarray, tag: int, make: Callable[[np.ndarray], pa.Table]) -> Iterator[pa.RecordBatch]:
    """A block for each part. make: from places of rows, the rows."""
    order = np.argsort(parts, kind="stable")
    bounds = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
    for a, b in zip(bounds, bounds[1:]):
        block = write(make(order[a:b]))
        yield pa.record_batch([pa.array([parts[order[a]]], pa.int32()), pa.array([tag], pa.int32()), pa.array([block], pa.binary())], ["part", "tag", "block"])


def deal(rows: DataFrame, key: str, tag: int, parts: int) -> DataFrame:
    """(part, tag, block) of rows, dealt by a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            yield from sent(table["_part"].to_numpy(), tag, table.drop_columns("_part").take)
            del table
            pa.default_memory_pool().release_unused()

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= HELD:
                size = 0
                yield from flush()
        if held:
            yield from flush()

    return rows.withColumn("_part", part(key, parts)).mapInArrow(run, SCHEMA)


def meet(dealt: list[DataFrame], parts: int, run: Callable[[Tables], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """What run makes of each part: it gets the part's rows by tag; a tag without rows is not there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, list[bytes]]] = {}
        for b in batches:
            for p, tag, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                found.setdefault(p, {}).setdefault(tag, []).append(block)
        while found:
            _, blocks = found.popitem()
            yield from run({tag: pa.concat_tables(map(read, xs)).combine_chunks() for tag, xs in blocks.items()})
            pa.default_memory_pool().release_unused()

    return reduce(DataFrame.unionAll, dealt).repartitionById(parts, "part").mapInArrow(each, schema)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    c = table[name]
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def codes(*columns: pa.Array) -> list[np.ndarray]:
    """The columns' values as numbers, alike for equal values of any of them, nulls too."""
    every = pc.dictionary_encode(pa.concat_arrays(columns), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(every, np.cumsum([len(c) for c in columns])[:-1])
