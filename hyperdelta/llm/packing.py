"""Best-fit packing of documents into sequences under token, document-count and attention-cost capacities.

What a piece needs is a vector that depends on its length alone: (tokens, 1, tokens^2). So the packing is decided on the
histogram of lengths, which has at most `capacity` rows whatever the corpus holds: lengths go from long to short, and the
open sequences, grouped by their residual vector, take as many pieces of a length at once as they are many. The plan is
arithmetic on ranks within a length; pieces find their place by their rank, in parallel, without moving any token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, ranges, texts
from .tokens import default_vocabulary, encode

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold. cost is the sum of squared lengths, as attention within documents costs."""

    tokens: int = 1024
    docs: int = 1024
    cost: int = 1024 * 1024


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole if it fits; else the remainder first, then full pieces."""
    first = n % most
    return ([first] if first else []) + [most] * (n // most)


def tokenized(docs: DataFrame, most: int, end_id: int, vocabulary: str) -> DataFrame:
    """A row for each piece. part and rank count the pieces of one length in one task, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            rows, lengths, piece, start, crc = [], [], [], [], []
            for i, text in enumerate(texts(batch.column(1))):
                ids = np.array([*encode(vocabulary, text), end_id], "<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), most)):
                    rows.append(i)
                    lengths.append(n)
                    piece.append(k)
                    start.append(at)
                    crc.append(zlib.crc32(ids[at : at + n].data))
                    at += n
            if not rows:
                continue
            n = np.array(lengths)
            order = np.argsort(n, kind="stable")
            counts = np.bincount(n, minlength=most + 1)
            rank = np.empty(len(n), np.int64)
            rank[order] = ranges(np.zeros(most + 1, np.int64), counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class _Open:
    """Open sequences by residual vector; of each vector the runs (first sequence, how many)."""

    def __init__(self) -> None:
        self.vectors, self.counts, self.runs = np.zeros((64, 3), np.int64), np.zeros(64, np.int64), []
        self.at: dict[tuple[int, int, int], int] = {}

    def put(self, vector: tuple[int, int, int], first: int, count: int) -> None:
        k = self.at.get(vector)
        if k is None:
            k = self.at[vector] = len(self.runs)
            if k == len(self.vectors):
                self.vectors, self.counts = np.concatenate([self.vectors] * 2), np.concatenate([self.counts, np.zeros(k, np.int64)])
            self.vectors[k] = vector
            self.counts[k] = 0
            self.runs.append([])
        self.runs[k].append((first, count))
        self.counts[k] += count

    def tight(self, shortest: int) -> None:
        """Forgets the sequences that no piece fits into any more, and vectors without any."""
        old, self.runs, self.at = list(zip(self.vectors.tolist(), self.runs)), [], {}
        for vector, runs in old:
            if runs and vector[0] >= shortest:
                for first, count in runs:
                    self.put(tuple(vector), first, count)


def plan(histogram: dict[int, int], capacity: Capacity = Capacity(), select: str = "norm", weights: tuple[float, float, float] = (1, 1, 1)) -> np.ndarray:
    """Vector best-fit decreasing on a histogram {length: pieces}.

    Rows (length, first rank, pieces, first sequence, pieces a sequence, offset): of the pieces of a length, those from the
    first rank on go to consecutive sequences, so many to each, side by side from the offset. select: of the sequences with
    room in every dimension, "norm" takes the one with the least weighted norm of what would be left, "dot" the one with the
    least weighted dot product of what is wanted and what is left, both as shares of the capacity.
    """
    full = np.array([capacity.tokens, capacity.docs, capacity.cost], float)
    w = np.array(weights, float)
    opened, rows, sequences = _Open(), [], 0
    lengths = sorted((n for n, c in histogram.items() if c), reverse=True)
    if lengths and (lengths[0] > capacity.tokens or lengths[0] ** 2 > capacity.cost or lengths[-1] < 1 or capacity.docs < 1):
        raise ValueError("a piece does not fit into an empty sequence")

    def left(tokens: int, docs: int, cost: int) -> tuple[int, int, int]:
        """The residual without slack: so many tokens can't hold more documents, nor cost more than their square."""
        return tokens, min(docs, tokens), min(cost, tokens * tokens)

    for length in lengths:
        count, rank, need = histogram[length], 0, np.array([length, 1, length * length])
        opened.tight(lengths[-1])
        while count:
            n = len(opened.runs)
            room = opened.vectors[:n]
            fits = np.flatnonzero((room >= need).all(axis=1) & (opened.counts[:n] > 0))
            if len(fits):
                score = (w * ((room[fits] - need) / full) ** 2).sum(axis=1) if select == "norm" else (w * need / full * room[fits] / full).sum(axis=1)
                k = int(fits[np.lexsort((room[fits, 0], score))[0]])
                first, many = opened.runs[k].pop()
                take = min(many, count)
                opened.counts[k] -= many
                tokens, docs, cost = map(int, opened.vectors[k])
                if take < many:
                    opened.put((tokens, docs, cost), first + take, many - take)
                rows.append((length, rank, take, first, 1, capacity.tokens - tokens))
                opened.put(left(tokens - length, docs - 1, cost - length * length), first, take)
                rank, count = rank + take, count - take
                continue
            each = min(capacity.tokens // length, capacity.docs, capacity.cost // (length * length), count)
            many = count // each
            rows.append((length, rank, many * each, sequences, each, 0))
            opened.put(left(capacity.tokens - each * length, capacity.docs - each, capacity.cost - each * length * length), sequences, many)
            sequences, rank, count = sequences + many, rank + many * each, count - many * each
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, capacity: Capacity = Capacity(), end_id: int = 2, vocabulary: str | None = None, select: str = "norm", weights: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text).

    A document's ids, then end_id. One that is longer than a sequence is cut into full pieces; its first piece may be
    shorter. A null text is empty, so it has one piece of one token. Rows with the same doc_id, or none, are documents of their own.
    """
    most = min(capacity.tokens, int(capacity.cost**0.5))
    pieces = cut(tokenized(docs, most, end_id, vocabulary or default_vocabulary()))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row a length
    rows = plan(histogram, capacity, select, weights)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("length", "part").count()
    parts = parts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(5).to_numpy()
            row = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(parts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, placed: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, doc_ids, offsets, ids) of packed sequences: the token ids side by side, for a trainer.

    docs need unique doc_ids. A sequence holds at most its capacity, so gathering one is bounded.
    """
    vocabulary = vocabulary or default_vocabulary()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[*encode(vocabulary, t), end_id] for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, ids array<int>")
    piece = placed.join(encoded, "doc_id").select("sequence_id", "offset", "doc_id", F.expr("slice(ids, cast(start + 1 AS INT), cast(length AS INT))").alias("ids"))
    gathered = piece.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return gathered.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), F.flatten("p.ids").alias("ids"))
