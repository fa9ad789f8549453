"""SimHash near-duplicate groups by anchor points of a covering code.

A fingerprint has two halves of 32 bits. Two fingerprints at 3 or fewer differing bits differ in at most one bit in one of
the halves. On a half, the anchors are the words of the perfect Hamming(31, 26) code with one free bit: 2^27 anchors, and
every half lies within covering radius 1 of its home anchor. A fingerprint is sent to every anchor within covering radius
plus threshold, 1 + 1 = 2, of either half (at most 17 a half); at each anchor, those at home are compared with all that came.
So every linked pair meets at the home anchor of either, with the full 64-bit distance checked there.

Equal fingerprints are merged before anything is replicated, so copies cost nothing. What an anchor gathers is not listed
as pairs: a large bucket gives only a spanning forest of its links, which has the same components, and compares only rows that
agree on two of five pieces of the other half, as all that link do.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, mapped, prepare, ranges, starts_of, texts
from .graph import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED, WIDTH, MAX_BITS = 42, 3, 3
#: Shingles whose bits are counted at once, and cells of a bucket that are compared at once.
CHUNK, TILE = 1 << 17, 1 << 20


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits; a bit is 1 if over half of the shingles' hashes have it. Without words it is 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    at = starts_of(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    first, last = at[:n].tolist(), (at[min(width, len(words)) :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + CHUNK], last[i : i + CHUNK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) of every row of docs (doc_id, text); fp is the fingerprint as a signed number, text_hash tells texts apart."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in texts(batch.column(1))], U64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], ["doc_id", "fp", "text_hash"])

    prepare(docs.sparkSession)
    return mapped(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")), each, "doc_id long, fp long, text_hash long")


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Of the Hamming(31, 26) code: the syndrome of each byte at each of four places, and for each syndrome the masks that
    lead to the code words within distance 2, the nearest first (padded with the first)."""
    syndrome = np.zeros((4, 256), np.uint8)
    for place in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * place + bit < 31:
                    syndrome[place, value] ^= 8 * place + bit + 1
    masks = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        pairs = [(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, 32) if i < i ^ s]
        masks[s] = [1 << s - 1, *pairs]
    return syndrome, masks


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor within distance 2 of a half of fp."""
    syndrome, masks = _code()
    out = []
    for half in (0, 1):
        bits = (fp >> U64(32 * half) & U64(0xFFFFFFFF)).astype(np.uint32)
        word, free = bits & np.uint32(0x7FFFFFFF), bits >> np.uint32(31)
        s = np.bitwise_xor.reduce([syndrome[k][word >> np.uint32(8 * k) & np.uint32(255)] for k in range(4)])
        near = word[:, None] ^ masks[s]
        rows = np.arange(len(fp))
        keep = np.ones(near.shape, bool)
        keep[:, 1:] = (s != 0)[:, None]  # a code word itself has no other within 2
        home = np.zeros(near.shape, bool)
        home[:, 0] = True
        key = near.astype(np.int64) << 1 | free[:, None]
        other = near[:, 0].astype(np.int64) << 1 | (1 - free.astype(np.int64))
        out.append((np.repeat(rows, 16).reshape(near.shape)[keep], key[keep] | half << 40, home[keep]))
        out.append((rows, other | half << 40, np.zeros(len(fp), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label after the groups of x and y, pair by pair, are joined: the least of each."""
    pair = np.unique(np.stack([label[x], label[y]], axis=1), axis=0)
    pair = pair[pair[:, 0] != pair[:, 1]]
    if not len(pair):
        return label
    root = {int(k): int(k) for k in np.unique(pair)}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for i, j in pair.tolist():
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    to = np.arange(len(label))
    for k in root:
        to[k] = find(k)
    return to[label]


def _forest(fp: np.ndarray, node: np.ndarray, home: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of linked rows of one bucket, in memory in proportion to the bucket.

    Rows that link differ in at most `bits` bits of the half that the anchor is not of, so, of bits + 1 and one more pieces of it, two
    are equal: rows are compared only where some two pieces are, not each with the whole bucket.
    """
    label = np.arange(len(fp))
    other = (fp >> U64(32 * (1 - half))) & U64(0xFFFFFFFF)
    edge = [round(32 * i / (bits + 2)) for i in range(bits + 3)]
    piece = [(other >> U64(a)) & U64((1 << b - a) - 1) for a, b in itertools.pairwise(edge)]
    for i, j in itertools.combinations(range(len(piece)), 2):
        key = piece[i] << U64(32) | piece[j]
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        sizes = np.diff(at)
        group = np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero(home[order] & (sizes[group] > 1))
        upto = np.cumsum(sizes[group[first]])
        start = 0
        while start < len(first):  # as many rows at once as make TILE cells, or one
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TILE, side="right")))
            r = first[start:end]
            n = sizes[group[r]]
            x, y = order[np.repeat(r, n)], order[ranges(at[group[r]], n)]
            hit = label[x] != label[y]
            x, y = x[hit], y[hit]
            hit = np.bitwise_count(fp[x] ^ fp[y]) <= bits
            label = _joined(label, x[hit], y[hit])
            start = end
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    return node, least[label]


def _links(anchor: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the rows at each anchor; the rows are sorted by anchor."""
    at = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    sizes = np.diff(at)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(sizes, sizes) <= 16
    rows = np.flatnonzero(home & small & (np.repeat(sizes, sizes) > 1))
    group = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(rows), TILE // 16):
        r = rows[i : i + TILE // 16]
        n = sizes[group[r]]
        x, y = np.repeat(r, n), ranges(at[group[r]], n)
        hit = (np.bitwise_count(fp[x] ^ fp[y]) <= bits) & (node[x] != node[y])
        a.append(node[x[hit]])
        b.append(node[y[hit]])
    for g in np.flatnonzero(sizes > 16):
        s = slice(at[g], at[g + 1])
        if home[s].any():
            x, y = _forest(fp[s], node[s], home[s], bits, int(anchor[at[g]] >> 40))
            a.append(x[x != y])
            b.append(y[x != y])
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return a, b
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between nodes (fp, node) whose components are those of all pairs at `bits` or fewer differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves with radius-1 anchors cover at most 3 differing bits")

    def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row, anchor, home = anchors(fp.view(U64))
        # a home row's anchor sorts like the others'; whether it is at home rides in the lowest bit
        return pa.RecordBatch.from_arrays([pa.array(anchor << 1 | home), pa.array(fp[row]), pa.array(node[row])], ["key", "fp", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _links(rows[0] >> 1, rows[1].view(U64), rows[2], (rows[0] & 1).astype(bool), bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            count += batch.num_rows
            if count < 1 << 16:
                continue
            rows = np.concatenate(held, axis=1)
            whole = int(np.searchsorted(rows[0] >> 1, rows[0, -1] >> 1))  # the last anchor may go on
            held, count = [rows[:, whole:]], 0 if whole else -rows.shape[1]
            if whole:
                yield flush(rows[:, :whole])
        if held:
            yield flush(np.concatenate(held, axis=1))

    sent = mapped(nodes.select("fp", "node"), replicate, "key long, fp long, node long")
    dealt = sent.repartition(F.expr("shiftright(key, 1)")).sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _grouped(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of every row; and (fp, component, component_id) of every fingerprint.

    The nodes are the fingerprints themselves, so a doc_id that has two texts does not join them, and texts without an id join others."""
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), bits))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, named.join(ids, "component")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id that the row's fingerprint reaches over links of `bits` or fewer differing bits,
    itself included. A null text is empty; documents without a word have fingerprint zero and link like any other. A null
    doc_id gets its group's component, or null if no row of the group has one. Repeated rows stay, each with its group's
    component. Other columns are not read.
    """
    prints, named = _grouped(docs, bits)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id, its row once if it repeats.

    Where that doc_id has several texts in the group, the one with the least hash stays; of rows with the same doc_id and text, the one
    whose other columns have the least hash. Texts of one doc_id that are in different groups are judged apart. Rows without a
    doc_id stay as they are. The columns are those of docs, whatever their names.
    """
    prints, named = _grouped(docs, bits)
    mine = prints.where("doc_id IS NOT NULL").join(named.select("fp", "component_id", "component"), "fp").where("doc_id = component_id")
    kept = mine.groupBy("component", F.col("doc_id").alias("_id")).agg(F.min("text_hash").alias("_text")).select("_id", "_text").distinct()
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("_hash"))
    once = Window.partitionBy("_id", "_text").orderBy("_hash")
    first = rows.join(kept, ["_id", "_text"]).withColumn("_place", F.row_number().over(once)).where("_place = 1").select("_row.*")
    return first.unionByName(docs.where(F.col("doc_id").isNull()))
