"""Benchmark decontamination: training passages as queries against a BM25 index of test items.

Items are indexed in blocks of consecutive numbers. A term's postings carry BM25 impacts, divided by what the item scores
against itself, so one threshold fits all items; each term also keeps its largest impact in each block, and in each of a few runs of blocks.
All passages of a batch run block-max WAND together: a passage whose terms' maxima stay below the threshold in every run has
no pivot; of the others only the blocks whose maxima reach the threshold are opened, and only their postings are scored. As the
threshold is fixed rather than a top-k heap's, that returns every (passage, item) at or above it.

A hit is verified on the words around the passage: the share of the item's question shingles and of its answer shingles that occur there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, ranges, runs, starts_of, texts

PARTS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: The index goes to every task as a whole up to this many characters of items; a larger benchmark is searched in shards of that size, with
#: the same statistics and so the same results.
INDEX_CHARS = 16_000_000
#: Runs of blocks that a term has a maximum for. Cells of passages by blocks that are looked at together.
COARSE, CELLS = 16, 1 << 22

HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, n_passages long"


@dataclass(frozen=True)
class Rule:
    """Passages of `window` words start every `window / 2` words. score: least share of an item's own BM25 score. overlap:
    least share of question shingles, and of answer shingles, of `shingle` words. answer: the share of an item's words, at
    its end, that counts as its answer where it has no answer of its own."""

    window: int = 128
    score: float = 0.7
    shingle: int = 5
    overlap: float = 0.8
    answer: float = 0.25
    k1: float = 1.2
    b: float = 0.75
    block: int = 16


def words(text: bytes | str) -> list[bytes]:
    """Lower case; ASCII letters and digits and all characters beyond ASCII make words, the rest parts them."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return text.lower().encode("utf-8", "replace").translate(PARTS).split()


def shingles(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """Those of `width` words; of fewer words, all of them as one."""
    return {tuple(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))} if tokens else set()


def split_item(question: str | None, answer: str | None, rule: Rule) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and answer; an answer of None is taken from the question's end."""
    q = words(question or "")
    if answer is not None:
        return q, words(answer)
    n = max(1, round(rule.answer * len(q)))
    return q[: len(q) - n], q[len(q) - n :]


class Index:
    """Items (item_id, question, answer); an answer of None is taken from the question's end. Items without words are left out."""

    def __init__(self, items: list[tuple[int, str, str | None]], rule: Rule, corpus: tuple[dict[bytes, int], int, float] | None = None) -> None:
        self.rule, self.ids, self.parts, lists = rule, [], [], []
        for item_id, question, answer in items:
            q, a = split_item(question, answer, rule)
            if q or a:
                self.ids.append(item_id)
                self.parts.append((shingles(q, rule.shingle), shingles(a, rule.shingle), len(q) + len(a)))
                lists.append(q + a)
        df, n_items, mean = corpus or document_frequencies(lists)
        # numbered in the order of the terms, so that sums run in the same order whatever the shard
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*lists)))}
        rows: list[tuple[int, int, float]] = []
        for i, tokens in enumerate(lists):
            tf: dict[bytes, int] = {}
            for t in tokens:
                tf[t] = tf.get(t, 0) + 1
            norm = rule.k1 * (1 - rule.b + rule.b * len(tokens) / mean)
            weight = {t: float(np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))) * f * (rule.k1 + 1) / (f + norm) for t, f in tf.items()}
            # of an item longer than half a window, a passage need hold but half a window
            own = sum(weight[t] for t in sorted(weight)) * min(1.0, rule.window / 2 / len(tokens))
            rows += [(vocabulary[t], i, x / own) for t, x in weight.items()]
        rows.sort()
        self.vocabulary = vocabulary
        term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int32)
        self.impact = np.array([r[2] for r in rows], np.float32)
        block = self.item // rule.block
        head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(rows) else np.zeros(0, np.int64)
        #: Of each term its blocks, and of each block its number, its largest impact and its postings.
        self.blocks = starts_of(np.bincount(term[head], minlength=len(vocabulary)))
        self.block = block[head].astype(np.int64)
        self.block_max = np.maximum.reduceat(self.impact, head) if len(head) else np.zeros(0, np.float32)
        self.postings = np.r_[head, len(rows)]
        #: The largest impact of each term in each of at most COARSE runs of blocks.
        per = -(-(len(lists) // rule.block + 1) // COARSE)
        self.coarse = np.zeros((len(vocabulary), min(COARSE, len(lists) // rule.block + 1)), np.float32)
        np.maximum.at(self.coarse, (term[head], self.block // per), self.block_max)

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold; the input lists the distinct terms of each of n passages."""
        least = np.float32(self.rule.score - 1e-6)
        if not len(passage):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        bound = np.zeros(n, np.float32)
        for i in range(0, len(first), 4096):
            s = slice(first[i], first[i + 4096] if i + 4096 < len(first) else len(passage))
            bound[passage[first[i : i + 4096]]] = np.add.reduceat(self.coarse[term[s]], first[i : i + 4096] - first[i], axis=0).max(axis=1)
        alive = bound[passage] >= least  # else there is no pivot
        passage, term = passage[alive], term[alive]
        n_blocks = len(self.ids) // self.rule.block + 1
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        where = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1], True]) if len(passage) else np.zeros(1, np.int64)
        step = max(1, min(4096, CELLS // n_blocks))  # passages at once, so that memory is bounded
        for i in range(0, len(where) - 1, step):
            s = slice(where[i], where[min(i + step, len(where) - 1)])
            count = self.blocks[term[s] + 1] - self.blocks[term[s]]
            entry = ranges(self.blocks[term[s]], count)
            local = np.cumsum(np.r_[0, np.diff(passage[s]) != 0])
            names = passage[s][np.r_[True, np.diff(passage[s]) != 0]]
            cell = np.repeat(local, count) * n_blocks + self.block[entry]
            upper = np.bincount(cell, self.block_max[entry], len(names) * n_blocks)
            opened = upper[cell] >= least
            entry, owner = entry[opened], np.repeat(local, count)[opened]
            count = self.postings[entry + 1] - self.postings[entry]
            posting = ranges(self.postings[entry], count)
            pair = np.repeat(owner, count) * len(self.ids) + self.item[posting]
            found, inverse = np.unique(pair, return_inverse=True)
            score = np.bincount(inverse, self.impact[posting], len(found))
            hit = score >= least
            out.append((names[found[hit] // len(self.ids)], found[hit] % len(self.ids), score[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))


def document_frequencies(lists: list[list[bytes]]) -> tuple[dict[bytes, int], int, float]:
    df: dict[bytes, int] = {}
    for tokens in lists:
        for t in set(tokens):
            df[t] = df.get(t, 0) + 1
    return df, len(lists), max(1.0, sum(map(len, lists)) / max(1, len(lists)))


def passages(contents: list[list[bytes]], number: dict[bytes, int], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as words: (passage, term) once for each term of the index, the text of each passage and its first word.

    A passage is two neighbouring half windows; a text of one half is one passage.
    """
    terms: list[int] = []
    sizes, text, begins = [], [], []
    known, number = set(number).intersection, number.__getitem__
    for i, tokens in enumerate(contents):
        if not tokens:
            continue
        halves = [known(tokens[k : k + half]) for k in range(0, len(tokens), half)]
        if len(halves) == 1:
            halves.append(set())
        for k in range(len(halves) - 1):
            before = len(terms)
            terms.extend(map(number, halves[k] | halves[k + 1]))
            sizes.append(len(terms) - before)
            text.append(i)
            begins.append(k * half)
    key = np.repeat(np.arange(len(sizes)), sizes) << 32 | np.array(terms, np.int64)
    key.sort()  # a passage's terms in their order, not a set's
    return key >> 32, key & 0xFFFFFFFF, np.array(text, np.int64), np.array(begins, np.int64)


Hit = tuple[int, int, float, float, float, int, int]


def search_batch(index: Index, contents: list[bytes]) -> list[Hit]:
    """(text, item, score, question overlap, answer overlap, first word, passages) of each verified hit, its best passage's figures."""
    return [(t + s.start, *hit) for s in runs(contents) for t, *hit in _search(index, contents[s])]


def _search(index: Index, contents: list[bytes]) -> list[Hit]:
    rule, number = index.rule, index.vocabulary
    lists = [words(t) for t in contents]
    passage, term, text, begins = passages(lists, number, rule.window // 2)
    found: dict[tuple[int, int], tuple] = {}
    for p, item, score in zip(*(x.tolist() for x in index.search(passage, term, len(text)))):
        t, at = int(text[p]), int(begins[p])
        question, answer, n = index.parts[item]
        around = shingles(lists[t][max(0, at - n) : at + rule.window + n], rule.shingle)
        if any(len(x) < rule.shingle for s in (question, answer) for x in s):  # shorter parts are compared at their own length
            widths = {len(x) for s in (question, answer) for x in s if len(x) < rule.shingle}
            for w in widths:
                around |= shingles(lists[t][max(0, at - n) : at + rule.window + n], w)
        q = len(question & around) / len(question) if question else 1.0
        a = len(answer & around) / len(answer) if answer else 1.0
        if q >= rule.overlap and a >= rule.overlap:
            old = found.get((t, item))
            best = max((score, -at, q, a), old[:4]) if old else (score, -at, q, a)
            found[t, item] = (*best, old[4] + 1 if old else 1)
    return [(t, item, s, q, a, -at, n) for (t, item), (s, at, q, a, n) in found.items()]


def _statistics(items: DataFrame, rule: Rule) -> DataFrame:
    """(shard, term, n): in how many items of a shard each term is; and of shard null, with terms of their own, the items and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int | None, bytes], int] = {}
            for question, answer, shard in zip(*(batch.column(i).to_pylist() for i in range(3))):
                q, a = split_item(question, answer, rule)
                if q or a:
                    for k in [*((shard, t) for t in {*q, *a}), (None, b"items")]:
                        seen[k] = seen.get(k, 0) + 1
                    seen[None, b"words"] = seen.get((None, b"words"), 0) + len(q) + len(a)
            if seen:
                shards, terms = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(terms, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shard", "term", "n"])

    return items.select("question", "answer", "shard").mapInArrow(run, "shard int, term binary, n long").groupBy("shard", "term").agg(F.sum("n").alias("n"))


def _indexes(items: DataFrame, rule: Rule) -> Iterator[Broadcast]:
    """The items' index, broadcast: one while they have at most INDEX_CHARS characters, else one for each shard of about that size.

    A shard is a random part of the items by hash; BM25 statistics are those of all items in every shard.
    """
    spark = items.sparkSession
    split = {"question", "answer"} <= set(items.columns)
    answer = F.col("answer") if split else F.lit(None).cast("string").alias("answer")
    items = items.select(F.col("item_id").cast("long"), F.col("question" if split else "text").alias("question"), answer)
    size = items.agg(F.sum(F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-size // INDEX_CHARS))
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")
    if shards == 1:
        yield spark.sparkContext.broadcast(Index(sorted(map(tuple, items.collect()), key=order), rule))
        return
    items = items.withColumn("shard", F.expr(f"cast(pmod(xxhash64(item_id, question), {shards}) AS INT)"))
    counts = cut(_statistics(items, rule))
    whole = {bytes(r["term"]): r["n"] for r in counts.where("shard IS NULL").collect()}
    n, mean = whole.get(b"items", 0), max(1.0, whole.get(b"words", 0) / max(1, whole.get(b"items", 0)))
    every = cut(counts.where("shard IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"), F.collect_set("shard").alias("shards")))
    for k in range(shards):  # a shard's items and terms at a time
        df = {bytes(r["term"]): r["n"] for r in every.where(F.array_contains("shards", k)).select("term", "n").toLocalIterator()}
        rows = sorted(map(tuple, items.where(F.col("shard") == k).drop("shard").collect()), key=order)
        yield spark.sparkContext.broadcast(Index(rows, rule, (df, n, mean)))


def contaminated(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A row for each document and test item whose question and answer both overlap with it.

    docs: doc_id, text. items: item_id and text, or item_id, question and answer. Words are runs of word characters, lower
    case. Null or empty texts and items match nothing. Repeated rows of docs give a row each; items with the same text are
    each found. score, first_word and the overlaps are those of the best-scoring passage, the first on ties.
    """
    prepare(docs.sparkSession)
    out = None
    for index in _indexes(items, rule):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = search_batch(index.value, texts(batch.column(1)))
                if rows:
                    t, item, *rest = zip(*rows)
                    arrays = [batch.column(0).take(pa.array(t)), pa.array([index.value.ids[i] for i in item], pa.int64())]
                    kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "n_passages"]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, kind) for x, kind in zip(rest, kinds)], names)

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HITS)
        out = found if out is None else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """docs without the rows whose text holds a test item, as contaminated() finds them. Other columns are passed through.

    Rows are judged where they are read, one by one; no text moves.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _indexes(items, rule):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in search_batch(index.value, texts(batch.column(at)))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
