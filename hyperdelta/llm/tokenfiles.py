"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A flat file is token ids side by side, two or four bytes each, little-endian; a separator id ends each document. It is read
in blocks of a fixed number of tokens, wherever documents lie. A block's separators are found in one vectorised comparison;
the block then gives the lengths of the documents that lie in it whole, and its head (tokens up to its first separator) and
tail (tokens after its last). A prefix scan over a file's blocks stitches a document that crosses blocks: its length is the
head plus all that blocks without a separator and the last tail before it have carried along; and it numbers the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, opened, prepare, stage_path, texts
from .tokens import default_vocabulary, encode_ordinary


@dataclass(frozen=True)
class Layout:
    """block: tokens. A vocabulary of at most 65,536 ids fits two bytes."""

    separator: int = 50256
    width: int = 2
    block: int = 1 << 18

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")


def scan(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(file, block, n_tokens, n_separators, head, tail, inner) of each row of blocks (file, block, data).

    head: tokens before the first separator; tail: tokens after the last; inner: lengths between separators. Without a
    separator head and inner are empty and the tail is the whole block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                if len(data or b"") % layout.width:
                    raise ValueError("a block ends inside a token")
                ids = np.frombuffer(data or b"", layout.dtype)
                at = np.flatnonzero(ids == layout.separator)
                if len(at):
                    rows.append((len(ids), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).tolist()))
                else:
                    rows.append((len(ids), 0, 0, len(ids), []))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["file", "block", "n_tokens", "n_separators", "head", "tail", "inner"])

    schema = "file string, block long, n_tokens long, n_separators long, head long, tail long, inner array<long>"
    return blocks.select("file", F.col("block").cast("long"), "data").mapInArrow(run, schema)


#: Blocks of a file that one step of the prefix scan goes over in order; what they hand on is one row of the next.
SPAN = 4096


def _carried(rows: DataFrame, of: list[str], by: str) -> DataFrame:
    """rows (n_tokens, n_separators, tail, and by) with what comes before each within `of`: carried, tokens since the last separator,
    and base, separators. n_tokens without a separator are all carried on; with one, only the tail is."""
    before = Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*of).orderBy(by)
    rows = rows.withColumn("_total", F.sum("n_tokens").over(upto))
    rows = rows.withColumn("_ended", F.when(F.col("n_separators") > 0, F.col("_total") - F.col("tail")))
    carried = F.col("_total") - F.col("n_tokens") - F.coalesce(F.last("_ended", ignorenulls=True).over(before), F.lit(0))
    return rows.withColumns({"carried": carried, "base": F.coalesce(F.sum("n_separators").over(before), F.lit(0))}).drop("_total", "_ended")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of each document, from scan() rows: documents of a file are numbered from 0, separators not counted.

    What follows a file's last separator is a document without an end; it is listed if it has a token. The scan has two levels, SPAN
    blocks and then their sums, so a file of any length is gone through by many tasks; the lengths inside blocks stay out of it.
    """
    narrow = scanned.select("file", "block", "n_tokens", "n_separators", "head", "tail", F.floor(F.col("block") / SPAN).alias("span"))
    within = cut(_carried(narrow, ["file", "span"], "block"))
    # of a span: its tokens, its separators, and what it hands on
    last = F.max_by(F.when(F.col("n_separators") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("n_tokens")), "block")
    spans = within.groupBy("file", "span").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_separators").alias("n_separators"), last.alias("tail"))
    spans = _carried(spans, ["file"], "span").select("file", "span", F.col("carried").alias("_carried"), F.col("base").alias("_base"))
    first = F.col("base") == 0  # no separator before in the span, so what the spans before hand on comes in
    rows = within.join(spans, ["file", "span"]).withColumn("carried", F.col("carried") + F.when(first, F.col("_carried")).otherwise(0)).withColumn("base", F.col("base") + F.col("_base"))
    inner = scanned.where("n_separators > 0").select("file", "block", "inner")
    lengths = F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))
    whole = rows.where("n_separators > 0").join(inner, ["file", "block"])
    closed = whole.select("file", "base", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")
    held = F.when(F.col("n_separators") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("n_tokens"))
    ends = rows.groupBy("file").agg(F.max_by(F.struct((F.col("base") + F.col("n_separators")).alias("ordinal"), held.alias("n_tokens")), "block").alias("e"))
    return closed.unionAll(ends.select("file", "e.ordinal", "e.n_tokens").where("n_tokens > 0"))


def count(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """stitch(scan(blocks))"""
    return stitch(cut(scan(blocks, layout)))


#: Blocks that a task reads, one after another, as long as that makes no more than the second number of tasks.
A_TASK, TASKS = 16, 100_000


def blocks_of(files: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(file, block, data) of flat files (file, bytes). Each task opens the files of its blocks and reads these alone, so a file of any
    size is read by many tasks. The last block is what is left; an empty file has none."""
    size = layout.block * layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, whole in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = opened(file)
                with store.open_input_file(path) as f:
                    data = f.read_at(min(size, whole - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    n = files.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 0
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / size))).alias("block")
    rows = files.where("bytes > 0").select("file", at, "bytes")
    # a stated number, as these rows are too small for Spark to see how much they read
    return rows.repartition(max(1, min(TASKS, -(-n // A_TASK))), "file", F.floor(F.col("block") / A_TASK)).mapInArrow(run, "file string, block long, data binary")


def read_blocks(spark: SparkSession, path: str, layout: Layout = Layout()) -> DataFrame:
    """(file, block, data) of the flat files at a path. Where only Spark reaches them, a file of at most 2 GB comes to a task as a whole."""
    found = spark.read.format("binaryFile").load(path)
    files = found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))  # no content is read
    first = files.first()
    try:
        opened(first["file"] if first else path)
    except (pa.ArrowInvalid, OSError):
        size = layout.block * layout.width
        at = F.posexplode(F.expr(f"sequence(0L, greatest(length(content) - 1, 0), {size}L)")).alias("block", "start")
        whole = found.select(F.col("path").alias("file"), "content", at)
        return whole.select("file", F.col("block").cast("long"), F.expr(f"substring(content, cast(start + 1 AS INT), {size})").alias("data"))
    return blocks_of(files, layout)


def write_files(docs: DataFrame, layout: Layout = Layout(), vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenizes docs (doc_id, text) into a flat file a task in the shared folder: its documents' ids side by side, each with a
    separator behind it, and nothing else. Gives (file, bytes) of the files, and (file, ordinal, doc_id) of their documents for callers
    that want names for the counts.

    Names are written with Spark's own commit, and name the attempt's file; a file of an attempt that was lost is in no name, and is
    not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([layout.separator], layout.dtype).tobytes()
    folder = stage_path(spark, "token-files")
    store, path = opened(folder)
    store.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        file = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        store, path = opened(file)
        size = first = 0
        held: list[tuple[int, pa.Array]] = []
        with store.open_output_stream(path) as f:
            for batch in batches:
                for text in texts(batch.column(1)):
                    data = np.array(encode_ordinary(vocabulary, text), layout.dtype).tobytes() + end
                    f.write(data)
                    size += len(data)
                held.append((first, batch.column(0)))
                first += batch.num_rows
        for at, ids in held:  # only when all is written
            n = len(ids)
            whole = pa.array([size] * n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), whole, pa.array(np.arange(at, at + n)), ids], ["file", "bytes", "ordinal", "doc_id"])

    flat = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, bytes long, ordinal long, doc_id long")
    named = stage_path(spark, "token-names")
    flat.write.option("compression", "zstd").parquet(named)
    stored = spark.read.parquet(named)
    return stored.groupBy("file").agg(F.max("bytes").alias("bytes")), stored.select("file", "ordinal", "doc_id")


def document_counts(docs: DataFrame, layout: Layout = Layout(), vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) of every row of docs, counted in the flat files that it is written to.

    The vocabulary's separator in a text is ordinary text. A null text is empty: no tokens. Rows with the same doc_id, or
    none, are documents of their own.
    """
    files, names = write_files(docs, layout, vocabulary)
    return names.join(count(blocks_of(files, layout), layout), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
