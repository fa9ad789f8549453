"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Counts are sharded. Tasks count the triples of their own texts and send them, packed, to parts of about PART triples each, dealt by the
middle word; the triples of a word that alone would fill a good share of a part are dealt by their first two words instead,
and its pairs are summed across parts, so no word makes a part large. A part then has all triples of a context (u, v), all pairs (v, w) and
contexts (v) of its other words, and counts them by itself; what it knows of words and of the pairs of frequent words goes on, packed, to
shards of the words, each summed by one task into tables of their own. A task has one part or one shard. Parts and tables keep raw counts, as
sorted key arrays in the shared folder; discounts are put in when one is read. The
model counts all documents labelled good in the training half, so it grows with the input. To score, a task hashes its words
once, holds HELD of them, joins them with one table after another and adds up their log-probabilities, with one table in memory at a
time. (A shuffle join would move every n-gram of the corpus, several times the input.)

A word is a run of characters other than ASCII white space, as written. A document is scored by its mean log-probability
a word, drawn towards that of its language by `prior` words, so that a few words alone reject nothing. A model of three words does
not see that a text repeats itself, so a word also has the probability of ending a triple that its document had before, or
has not: the rate of the language's trusted documents. It is rejected above
its language's threshold: a quantile of the trusted documents, scored with all their own, plus a margin.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHashes, cut, drop, hash_long, opened, prepare, stage_path, starts_of, texts

BEGIN = WordHashes()[b""]  # the word before the first; no word is empty
#: Triples of a part of the model, words of a table of words, words that a task counts or holds at once.
PART, WORDS, COUNTED, HELD = 400_000, 2_000_000, 1_000_000, 2_000_000
#: Rows that may be sent to every task; what has more is joined by shuffling.
SENT = 4_000_000
#: Rows of scores that a task holds before it writes them.
ROWS = 100_000


@dataclass(frozen=True)
class Policy:
    """quantile: of the trusted documents of a language; margin: in units of that quantile's distance from the median.
    prior: words."""

    quantile: float = 0.99
    margin: float = 0.5
    prior: float = 20.0
    least_trusted: int = 20


def _squeezed(x: np.ndarray) -> tuple[int, bytes]:
    return x.nbytes, pa.compress(x.tobytes(), "zstd", asbytes=True)


def _restored(x: tuple[int, bytes]) -> bytes:
    return pa.decompress(x[1], x[0], "zstd", asbytes=True)


class Table:
    """A map from 64-bit hashes to rows of numbers, by look-up in arrays."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray) -> None:
        order = np.argsort(keys.view(U64))
        # counts are kept as narrow as they fit
        self._set(keys.view(U64)[order], {k: v[order].astype(np.min_scalar_type(int(v.max(initial=0))) if v.dtype.kind in "iu" else v.dtype) for k, v in values.items()})

    def __getstate__(self) -> tuple:
        """Compressed: the keys as differences, byte by byte, of which the upper are zero."""
        gaps = np.diff(self.keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
        return len(self.keys), _squeezed(np.ascontiguousarray(gaps)), {k: (v.dtype.str, _squeezed(v)) for k, v in self.values.items()}

    def __setstate__(self, state: tuple) -> None:
        n, gaps, values = state
        keys = np.cumsum(np.ascontiguousarray(np.frombuffer(_restored(gaps), np.uint8).reshape(8, n).T).view(U64).ravel(), dtype=U64)
        self._set(keys, {k: np.frombuffer(_restored(v), dtype) for k, (dtype, v) in values.items()})

    def _set(self, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
        self.keys, self.values = keys, values
        self.bits = max(1, int(len(self.keys)).bit_length())
        shard = (self.keys >> U64(64 - self.bits)).astype(np.int64)
        self.at = starts_of(np.bincount(shard, minlength=1 << self.bits)).astype(np.int32)

    def column(self, name: str, missing: float = 0.0) -> np.ndarray:
        """Of all rows, and a last one for keys that are missing."""
        return np.r_[self.values[name].astype(np.float32), np.float32(missing)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; that of the last row for a key that is missing."""
        shard = (keys >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.at[shard], self.at[shard + 1]
        out = np.full(len(keys), len(self.keys), np.int32)
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = at[hit]
            at += 1
            on = ~hit & (at < end)
            open_, at, end = open_[on], at[on], end[on]
        return out


Discounts = tuple[float, float, float]


def _less(counts: np.ndarray, d: Discounts) -> np.ndarray:
    """Counts less their discounts; of zero, zero."""
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def _narrow(counts: np.ndarray, d: Discounts) -> np.ndarray:
    """_less() of counts, and a last row for those that are missing."""
    return np.r_[_less(counts, d), 0.0].astype(np.float32)


def _weights(table: Table, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts (s: sum of their counts, n1, n2, n3: how many are 1, 2, and 3 or more): 1 / s, and the weight of the lower
    order; 0 and 1 for one that is missing."""
    s, *n = (table.column(c) for c in ("s", "n1", "n2", "n3"))
    s[-1] = 1
    weight = sum(a * np.float32(b) for a, b in zip(n, d)) / s
    inverse = 1 / s
    inverse[-1], weight[-1] = 0, 1
    return inverse, weight


def _contexts(context: np.ndarray, counts: np.ndarray) -> Table:
    """Of counts by context: the rows that _weights takes."""
    order = np.argsort(context, kind="stable")
    context, counts = context[order], counts[order]
    new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    total = lambda x: np.add.reduceat(x.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    return Table(context[new], s=total(counts), n1=total(counts == 1), n2=total(counts == 2), n3=total(counts > 2))


@dataclass
class Words:
    """What is known of words by themselves (c: how many words come before), and of the pairs of frequent words (c): tables by the hash of
    the word or pair, in shards by the word, or the second word of the pair."""

    files: list[str]
    unseen: float  # log p of a word that is not in the model
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # sorted
    pairs: list[str] = field(default_factory=list)
    contexts: Table | None = None  # of frequent words
    d2: Discounts = (0.5, 0.75, 0.9)
    d1: Discounts = (0.5, 0.75, 0.9)
    total: float = 1.0  # of the words' c
    held: dict[str, Table] = field(default_factory=dict)

    def _tables(self, files: list[str]) -> Iterator[tuple[int, Table]]:
        for k, f in enumerate(files):
            table = self.held.get(f) or _read(f)
            if len(files) == 1:
                self.held[f] = table
            yield k, table

    def log_p(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.unseen, np.float32)
        for k, table in self._tables(self.files):
            mine = np.flatnonzero(hashes % U64(len(self.files)) == k) if len(self.files) > 1 else slice(None)
            p = np.r_[np.log(_less(table.values["c"], self.d1) / self.total + np.exp(self.unseen)), self.unseen].astype(np.float32)
            out[mine] = p[table.find(hashes[mine])]
        return out

    def is_frequent(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.frequent, words), max(0, len(self.frequent) - 1))
        return self.frequent[at] == words if len(self.frequent) else np.zeros(len(words), bool)

    def second_tables(self) -> Iterator[Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]]:
        """Functions to be called one after another with (p2, words before, words, log p of the words): the first sets p2 to the
        probability of a word after a frequent one, if the pair is unknown, or to NaN after one that is not; each of the others
        puts in what its table of pairs has."""

        def start(p2: np.ndarray, before: np.ndarray, words: np.ndarray, p1: np.ndarray) -> None:
            p2[:] = np.nan
            some = np.flatnonzero(self.is_frequent(before))
            if len(some):
                p2[some] = _weights(self.contexts, self.d2)[1][self.contexts.find(before[some])] * np.exp(p1[some])

        yield start
        if not len(self.frequent):
            return
        for k, table in self._tables(self.pairs):

            def put(p2: np.ndarray, before: np.ndarray, words: np.ndarray, p1: np.ndarray, k: int = k, table: Table = table, counts: np.ndarray = _narrow(table.values["c"], self.d2)) -> None:
                some = np.flatnonzero(~np.isnan(p2) & (words % U64(len(self.pairs)) == k))
                keys = hash_long(words[some], hash_long(before[some], 42))
                p2[some] += counts[table.find(keys)] * _weights(self.contexts, self.d2)[0][self.contexts.find(before[some])]

            yield put


def part_of(before2: np.ndarray, before: np.ndarray, frequent: np.ndarray, parts: int) -> np.ndarray:
    """The part that has what a word after these two needs; frequent: whether the word before is."""
    return np.where(frequent, hash_long(before, hash_long(before2, 42)), before) % U64(parts)


@dataclass
class Model:
    """All of a model, or one of its parts. Raw counts; d2 and d3 are the discounts."""

    contexts: Table  # of a word
    pairs: Table  # c
    histories: Table  # contexts of two words
    triples: Table  # c
    part: int = 0
    parts: int = 1
    d2: Discounts = (0.5, 0.75, 0.9)
    d3: Discounts = (0.5, 0.75, 0.9)
    words: Words | None = None

    def ready(self) -> Model:
        self._contexts, self._histories = _weights(self.contexts, self.d2), _weights(self.histories, self.d3)
        self._pairs, self._triples = (_narrow(t.values["c"], d) for t, d in ((self.pairs, self.d2), (self.triples, self.d3)))
        return self

    def log_probabilities(self, before2: np.ndarray, before: np.ndarray, words: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Of words of this part after two others; p1: the log-probability of each without them, p2: the probability of those
        after a frequent word."""
        inverse, weight = self._contexts
        at = self.contexts.find(before)
        own = self._pairs[self.pairs.find(hash_long(words, hash_long(before, 42)))] * inverse[at] + weight[at] * np.exp(p1)
        p = np.where(np.isnan(p2), own, p2)
        history = hash_long(before, hash_long(before2, 42))
        at = self.histories.find(history)
        inverse, weight = self._histories
        p = p * weight[at]
        some = np.flatnonzero(at < len(self.histories.keys))  # no triple without its context
        p[some] += self._triples[self.triples.find(hash_long(words[some], history[some]))] * inverse[at[some]]
        return np.log(p)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that all their labels call good and not toxic; nulls say nothing."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return known.where("q = 1 AND t = 0").select("doc_id")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, to be sent to every task if they are at most SENT (counted first)."""
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts to train on: all documents labelled good and not toxic. Only their ids are sent out, as long as they are few."""
    return docs.join(_sent(trusted_ids(labels)), "doc_id", "left_semi").select("text")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of about COUNTED words of texts side by side, two begin marks before each; and which places hold words to count.
    A long text comes in pieces, the last two words of one leading the next."""
    known, held, begin, size = WordHashes(), [], np.array([BEGIN, BEGIN]).view(U64), 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        at = starts_of(np.array([len(h) for h in held]))[:-1]
        count = np.ones(sum(map(len, held)), bool)
        count[at] = count[at + 1] = False
        return np.concatenate(held), count

    for batch in batches:
        for text in texts(batch.column(0)):
            h = np.r_[begin, word_hashes(text, known)]
            for i in range(0, len(h) - 2, COUNTED):
                held.append(h[i : i + COUNTED + 2])
                size += len(held[-1])
                if size >= COUNTED:
                    yield joined()
                    held, size = [], 0
    if held:
        yield joined()


def _word_counts(trusted: DataFrame) -> DataFrame:
    """(w, n) of every word, the begin mark before a text among them, as often as it has a word behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, count in _sequences(batches):
            w, n = np.unique(words[np.flatnonzero(count) - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    return trusted.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _grouped(group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that has rows, with their numbers."""
    order = np.argsort(group, kind="stable")
    ends = starts_of(np.bincount(group, minlength=groups))
    for g in np.flatnonzero(np.diff(ends)).tolist():
        yield g, order[ends[g] : ends[g + 1]]


def _packed(rows: Iterator[tuple[int, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """(part, data), compressed, in batches of about 16 MB."""
    numbers, data, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], ["part", "data"])

    for number, what in rows:
        packed = pickle.dumps(what, protocol=5)
        numbers.append(number)
        data.append(pa.compress(packed, "zstd", asbytes=True) + len(packed).to_bytes(8, "little"))
        size += len(data[-1])
        if size > 16 << 20:
            yield batch()
            numbers, data, size = [], [], 0
    if data:
        yield batch()


def _opened(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), "zstd", asbytes=True))


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    """packed (part, data), each part in a task of its own: by a hash of the part several would meet in one task, and others have none."""
    return packed.repartitionById(parts, F.col("part").cast("int"))


def _triples(trusted: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """(part, data): the counted triples of a task's texts for each part, packed: their words once, then three narrow word numbers
    and the count of each triple."""
    is_frequent = Words([], 0.0, frequent).is_frequent

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        for sequence, count in _sequences(batches):
            words, number = np.unique(sequence, return_inverse=True)
            at = np.flatnonzero(count)
            key = (number[at - 1] << 42) | (number[at] << 21) | number[at - 2]  # there are fewer than 2^21 words
            key, n = np.unique(key, return_counts=True)
            v, w, u = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
            part = part_of(words[u], words[v], is_frequent(words)[v], parts).astype(np.int64)
            for p, mine in _grouped(part, parts):
                own, k = np.unique(np.concatenate([v[mine], w[mine], u[mine]]), return_inverse=True)
                yield p, (words[own], *(x.astype(np.min_scalar_type(int(x.max()))) for x in (*k.reshape(3, -1), n[mine])))

    return trusted.mapInArrow(lambda batches: _packed(rows(batches)), "part long, data binary")


def _unpacked(data: bytes) -> np.ndarray:
    """Rows v, w, u (as words) and n."""
    words, v, w, u, n = _opened(data)
    return np.stack([words[v], words[w], words[u], n.astype(U64)])


def _discounts(n: list[int]) -> Discounts:
    """Of Chen and Goodman, from how many n-grams have the counts 1, 2, 3 and 4: for counts of 1, of 2, and of 3 or more."""
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k - 0.01, max(0.01, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))


def _dump(what: object, uri: str) -> None:
    files, path = opened(uri)
    with files.open_output_stream(path) as f:
        pickle.dump(what, f, protocol=5)


def _read(uri: str) -> object:
    files, path = opened(uri)
    with files.open_input_file(path) as f:
        return pickle.loads(f.read_buffer())


def load(uri: str) -> Model | Words:
    """The words, or a part with its discounts; a part without a triple has no file."""
    what, _, name = uri.rpartition("/")
    if name == "words":
        return _read(uri)
    parts, some, d2, d3 = _read(f"{what}/about")
    model = _read(uri) if int(name) in some else _build([], np.zeros(0, U64))[0]
    model.part, model.parts, model.d2, model.d3 = int(name), parts, d2, d3
    return model.ready()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if len(columns[0]) else np.zeros(0, np.int64)


def _few(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _build(rows: list[np.ndarray], frequent: np.ndarray) -> tuple[Model, dict[str, tuple[np.ndarray, ...]]]:
    """A part from its rows (v, w, u, n); and what is summed across parts: of words how many pairs end with them (ends: w, c), the pairs
    of frequent words (pairs: w, v, c), and how many triples and other pairs have a count of 1 to 4 (few)."""
    v, w, u, n = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), U64)
    order = np.lexsort((u, w, v))
    v, w, u, n = v[order], w[order], u[order], n[order]
    new = _heads(v, w, u)
    c3 = np.add.reduceat(n.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    v, w, u = v[new], w[new], u[new]
    history = hash_long(v, hash_long(u, 42))
    triples = Table(hash_long(w, history), c=c3)
    at = _heads(v, w)
    c2, v, w = np.diff(np.r_[at, len(v)]), v[at], w[at]
    often = Words([], 0.0, frequent).is_frequent(v)
    rare = ~often
    out = {"ends": np.unique(w[rare], return_counts=True), "pairs": (w[often], v[often], c2[often]), "few": (_few(c3), _few(c2[rare]))}
    pairs = Table(hash_long(w[rare], hash_long(v[rare], 42)), c=c2[rare])
    return Model(_contexts(v[rare], c2[rare]), pairs, _contexts(history, c3), triples), out


def train(trusted: DataFrame) -> Model:
    """The model of the words of trusted (text), in one part."""
    words, model = map(load, store(trusted, None))
    model.words = words
    return model


def store(trusted: DataFrame, most: int | None = PART) -> list[str]:
    """Where the model of the words of trusted (text) is: its words, and parts of about `most` triples each. Without a word in it,
    every word has the same probability. A word that begins more than a quarter of `most` triples' ends is frequent."""
    spark = trusted.sparkSession
    prepare(spark)
    folder = stage_path(spark, "model")
    files, path = opened(folder)
    files.create_dir(path)
    parts, shards, frequent = 1, 1, np.zeros(0, U64)
    if most:
        counts = _word_counts(trusted).groupBy(F.when(F.col("n") > most // 4, F.col("w")).alias("w")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
        total = sum(r["n"] for r in counts)
        parts = max(1, -(-total // most))
        shards = max(1, -(-max(total // 4, sum(r["words"] for r in counts)) // WORDS))  # of words, and of the pairs of frequent words, which are fewer than the triples
        if parts > 1:  # of these there are at most four a part
            frequent = np.sort(np.array([r["w"] for r in counts if r["w"] is not None], np.int64).view(U64))
        _collect(spark)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """Writes the part of a task; what each shard of the words needs of it."""
        part, held = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(_unpacked(data.as_py()))
        if held:
            model, out = _build(held, frequent)
            _dump(model, f"{folder}/{part}")
            ends, pairs = (dict(_grouped((out[c][0] % U64(shards)).astype(np.int64), shards)) for c in ("ends", "pairs"))
            none = np.zeros(0, np.int64)
            for s in range(shards):
                if not s or s in ends or s in pairs:
                    e, p = ends.get(s, none), pairs.get(s, none)
                    yield s, (*(x[e] for x in out["ends"]), *(x[p] for x in out["pairs"]), *(x if not s else np.zeros(4, np.int64) for x in out["few"]), np.array([part] if not s else none))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the tables of a task's shard. (kind, a, c), to be summed: how many words (0), pairs (1) and triples (2) have a count of 1 to 4; the words
        and their sum (3); parts (4) and shards (5); of a frequent word, the rows that _weights takes (6 to 9)."""
        shard, held = None, []
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(_opened(data.as_py()))
        if not held:
            return
        ends, c1, w, v, c2, few3, few2, done = map(np.concatenate, zip(*held))
        held.clear()
        order = np.lexsort((w, v))
        w, v, c2 = w[order], v[order], c2[order]
        at = _heads(v, w)
        w, v, c2 = w[at], v[at], np.add.reduceat(c2, at) if len(at) else c2
        ends, c1 = np.r_[ends, w], np.r_[c1, np.ones(len(w), np.int64)]  # a pair of a frequent word ends once with its word
        order = np.argsort(ends)
        ends, c1 = ends[order], c1[order]
        at = _heads(ends)
        ends, c1 = ends[at], np.add.reduceat(c1, at) if len(at) else c1
        _dump(Table(ends, c=c1), f"{folder}/word-{shard}")
        _dump(Table(hash_long(w, hash_long(v, 42)), c=c2), f"{folder}/pair-{shard}")
        known, few = _contexts(v, c2), np.arange(1, 5)
        out = [(0, few, _few(c1)), (1, few, few2.reshape(-1, 4).sum(0) + _few(c2)), (2, few, few3.reshape(-1, 4).sum(0)), (3, np.arange(3), np.array([len(c1), c1.sum(), np.count_nonzero(c1 > 2)])), (4, done, np.ones(len(done), np.int64)), (5, np.array([shard]), np.ones(1, np.int64))]
        out += [(6 + i, known.keys, known.values[c]) for i, c in enumerate(("s", "n1", "n2", "n3"))]
        columns = [np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out]), *(np.concatenate([x[i].astype(U64).view(np.int64) for x in out]) for i in (1, 2))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "c"])

    packed = _dealt(_triples(trusted, frequent, parts), parts).mapInArrow(lambda batches: _packed(built(batches)), "part long, data binary")
    sums = _dealt(packed, shards).mapInArrow(summed, "kind int, a long, c long").groupBy("kind", "a").agg(F.sum("c").alias("c")).collect()  # a row a part and a shard, four a frequent word, and fifteen
    _collect(spark)
    got = {(r["kind"], r["a"]): r["c"] for r in sums}
    n1, n2, n3 = ([got.get((kind, k), 0) for k in (1, 2, 3, 4)] for kind in (0, 1, 2))
    n, s, more = (got.get((3, k), 0) for k in (0, 1, 2))
    d1, d2, d3 = map(_discounts, (n1, n2, n3))
    rest = (n1[0] * d1[0] + n1[1] * d1[1] + more * d1[2]) / s if s else 1.0
    rest /= n + 1  # each word's share of what the discounts leave; one word stands for all unseen
    for k in range(shards):
        if (5, k) not in got:
            for name in ("word", "pair"):
                _dump(Table(np.zeros(0, np.int64), c=np.zeros(0, np.int64)), f"{folder}/{name}-{k}")
    own = np.array([a for kind, a in got if kind == 6], np.int64)
    contexts = Table(own, **{c: np.array([got[6 + i, a] for a in own.tolist()], np.int64) for i, c in enumerate(("s", "n1", "n2", "n3"))})
    word, pair = ([f"{folder}/{name}-{k}" for k in range(shards)] for name in ("word", "pair"))
    _dump(Words(word, float(np.log(rest)), frequent, pair, contexts, d2, d1, float(s or 1)), f"{folder}/words")
    _dump((parts, {a for kind, a in got if kind == 4}, d2, d3), f"{folder}/about")
    return [f"{folder}/{x}" for x in ("words", *range(parts))]


def _collect(spark: SparkSession) -> None:
    """Lets go of shuffle files that nothing refers to any more: Spark deletes them when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\t-\r ]")


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    """Of the words of a text. A long one is split piece by piece, so that its words are not all held at once."""
    if len(text) <= PIECE:
        return known.of(text.split())
    out, at = [], 0
    while at < len(text):
        cut_at = SPACE.search(text, at + PIECE)
        end = cut_at.start() if cut_at else len(text)
        out.append(known.of(text[at:end].split()))
        at = end
    return np.concatenate(out)


def _hashed(contents: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all."""
    lists = [word_hashes(t, known) for t in contents]
    return np.fromiter(map(len, lists), np.int64, len(lists)), np.concatenate(lists) if len(lists) else np.zeros(0, U64)


def repeats(n: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each text, how many words end a triple of words that the text had before."""
    out, at = np.zeros(len(n), np.int64), starts_of(n)
    for i in np.flatnonzero(n > 3).tolist():
        own = hashes[at[i] : at[i + 1]]
        with np.errstate(over="ignore"):
            key = np.sort((own[:-2] * U64(0x9E3779B97F4A7C15) + own[1:-1]) * U64(0xC2B2AE3D27D4EB4F) + own[2:])
        out[i] = np.count_nonzero(key[1:] == key[:-1])
    return out


#: Words whose parts are found at once.
STEP = 1 << 18


def _sums(parts: list[str] | list[Model], words: Words, n: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The sum of log-probabilities of each text, as far as they are of these parts.

    What is held of each word is its hash, two probabilities, its text, its part, and its place in their order; the rest is made of
    slices."""
    total = np.zeros(len(n))
    if not len(hashes):
        return total
    at = starts_of(n + 2)  # two begin marks before each text
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    places = (np.arange(len(hashes), dtype=np.int64) + 2 * (text.astype(np.int64) + 1)).astype(np.int32 if at[-1] < 1 << 31 else np.int64)
    sequence = np.full(int(at[-1]), BEGIN, np.int64).view(U64)
    sequence[places] = hashes
    p1, p2 = words.log_p(hashes), np.empty(len(hashes), np.float32)
    one = parts[0] if isinstance(parts[0], Model) else None
    count = one.parts if one else len(parts)
    part = np.zeros(len(hashes), np.min_scalar_type(count))
    for i in range(0, len(hashes), STEP):
        s = slice(i, i + STEP)
        before = sequence[places[s] - 1]
        part[s] = part_of(sequence[places[s] - 2], before, words.is_frequent(before), count)
    for known in words.second_tables():
        for i in range(0, len(hashes), STEP):
            s = slice(i, i + STEP)
            known(p2[s], sequence[places[s] - 1], hashes[s], p1[s])
    order = np.argsort(part, kind="stable").astype(places.dtype)
    ends = starts_of(np.bincount(part, minlength=count))
    for model in parts:
        model = model if one else load(model)  # one in memory at a time
        for i in range(int(ends[model.part]), int(ends[model.part + 1]), STEP):
            mine = order[i : min(i + STEP, int(ends[model.part + 1]))]
            log_p = model.log_probabilities(sequence[places[mine] - 2], sequence[places[mine] - 1], hashes[mine], p1[mine], p2[mine])
            total += np.bincount(text[mine], log_p, len(n))
    return total


def score_batch(model: Model, contents: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log-probabilities) of each text."""
    n, hashes = _hashed(contents, known)
    return n, _sums([model], model.words, n, hashes)


def _score_batches(stored: list[str], batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with (words, repeats, sum of log-probabilities) of its rows' texts, over all parts of the model."""
    known, held, size = WordHashes(), [], 0
    words, parts = load(stored[0]), stored[1:]
    if len(parts) == 1:
        parts = [load(parts[0])]

    def flush() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        n, hashes = np.concatenate([n for _, n, _ in held]), np.concatenate([h for _, _, h in held])
        rows = [(batch, own) for batch, own, _ in held]
        held.clear()
        again, total = repeats(n, hashes), _sums(parts, words, n, hashes)
        at = 0
        for batch, own in rows:
            s = slice(at, at + len(own))
            at += len(own)
            yield batch, own, again[s], total[s]

    for batch in batches:
        held.append((batch, *_hashed(texts(batch.column(text)), known)))
        size += len(held[-1][2])
        if size >= HELD or len(stored) == 2:
            yield from flush()
            size = 0
    if held:
        yield from flush()


SCORES = ("n_words", "n_repeats", "log_p")


def _with_scores(docs: DataFrame, stored: list[str], names: tuple[str, str, str]) -> DataFrame:
    """docs with three more columns: words, repeats, sum of log-probabilities."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *found in _score_batches(stored, batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, *names])

    schema = docs.schema
    for name, kind in zip(names, ("long", "long", "double")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, stored: list[str]) -> DataFrame:
    """(doc_id, lang, n_words, n_repeats, log_p) of every row of docs, computed once and kept in the shared folder. The workers write
    them, so that no text goes back; only files of tasks that ended well are read."""
    lang = F.col("lang").cast("string" if dict(docs.dtypes)["lang"] == "void" else docs.schema["lang"].dataType)  # no file has a column of no type
    spark, rows = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), "text")
    schema = rows.drop("text").schema
    for name, kind in zip(SCORES, ("long", "long", "double")):
        schema = schema.add(name, kind)
    folder = stage_path(spark, "scores")
    files, path = opened(folder)
    files.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held, to = None, [], f"{folder}/{uuid.uuid4().hex}.parquet"

        def write() -> None:
            nonlocal writer
            table = pa.Table.from_batches(held)
            if not writer:
                files, path = opened(to)
                writer = pq.ParquetWriter(path, table.schema, filesystem=files, compression="zstd")
            writer.write_table(table)
            held.clear()

        for batch, *found in _score_batches(stored, batches, 2):
            held.append(pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, found)], schema.names))
            if sum(map(len, held)) >= ROWS:
                write()
        if held:
            write()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([to])], ["file"])

    written = [r["file"] for r in rows.mapInArrow(run, "file string").collect()]  # a row a task
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def _cost(names: tuple[str, str, str] = SCORES) -> Column:
    """The negative log-probability of a document's words and repeats, given the rate of repeats."""
    n, again, log_p = map(F.col, names)
    return -(log_p + again * F.ln("rate") + (n - again) * F.ln(1 - F.col("rate")))


def _score(prior: float, names: tuple[str, str, str] = SCORES) -> Column:
    """Mean cost a word, drawn towards `mean` by the prior's words."""
    return (F.lit(prior) * F.col("mean") + _cost(names)) / (F.col(names[0]) + F.lit(prior))


def thresholds(scores: DataFrame, trusted: DataFrame, policy: Policy) -> DataFrame:
    """(lang, rate, mean, threshold) of the languages with enough trusted documents; and a row without lang of all together, last."""
    held = scores.where("n_words > 0").join(_sent(trusted), "doc_id", "left_semi")
    rate = ((F.sum("n_repeats") + 1) / (F.sum("n_words") + 2)).alias("rate")
    q = F.percentile_approx(_score(policy.prior), F.array(F.lit(0.5), F.lit(policy.quantile)), 20000)
    limit = (q[1] + policy.margin * (q[1] - q[0])).alias("threshold")
    sums = held.groupBy("lang").agg(rate, F.sum("n_words").alias("n"), F.sum("n_repeats").alias("r"), F.sum("log_p").alias("l"), F.count(F.lit(1)).alias("docs"))
    mean = (-(F.col("l") + F.col("r") * F.ln("rate") + (F.col("n") - F.col("r")) * F.ln(1 - F.col("rate"))) / F.col("n")).alias("mean")
    known = sums.where("lang IS NOT NULL").where(F.col("docs") >= policy.least_trusted).select("lang", "rate", mean)
    own = held.join(known, "lang").groupBy("lang", "rate", "mean").agg(limit)
    whole = held.agg(rate, F.sum("n_words").alias("n"), F.sum("n_repeats").alias("r"), F.sum("log_p").alias("l")).select("rate", mean).first()
    both = held.withColumns({c: F.lit(whole[c]).cast("double") for c in ("rate", "mean")}).groupBy("rate", "mean").agg(limit)
    return own.unionAll(both.select(F.lit(None).cast("string").alias("lang"), "rate", "mean", "threshold"))


@dataclass
class Classifier:
    stored: list[str]  # where the model is
    policy: Policy
    scores: DataFrame
    limits: DataFrame  # by language

    def judged(self, rows: DataFrame, lang: str, names: tuple[str, str, str], out: tuple[str, str]) -> DataFrame:
        """rows with the score and the threshold of their language or, without one, of all."""
        least = self.limits.where("lang IS NULL").first()
        limits = self.limits.where("lang IS NOT NULL").select(F.col("lang").alias("_lang"), *(F.col(c).alias(f"_{c}") for c in ("rate", "mean", "threshold")))
        limits = F.broadcast(limits) if limits.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES else limits
        kept = rows.columns
        # the rows' own columns are packed away, so that no name of theirs can clash
        packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{lang}`").alias("_of"), *(F.col(c).alias(o) for c, o in zip(names, SCORES)))
        joined = packed.join(limits, F.col("_of") == F.col("_lang"), "left")
        joined = joined.withColumns({c: F.coalesce(f"_{c}", F.lit(least[c] if least else None).cast("double")) for c in ("rate", "mean", "threshold")})
        return joined.select("_row.*", _score(self.policy.prior).alias(out[0]), F.col("threshold").alias(out[1]))


#: Thresholds of at most so many languages are sent to every task; of more they are joined by shuffling.
MAX_LANGUAGES = 50_000


def fit(docs: DataFrame, labels: DataFrame, policy: Policy = Policy(), most: int = PART, every: bool = True) -> Classifier:
    """Trains on one half of the trusted documents, and sets thresholds by the other half. Scores all documents, or only those
    of that half."""
    prepare(docs.sparkSession)
    half = F.expr("pmod(xxhash64(doc_id, 'half'), 2)")
    stored = store(training_texts(docs, labels.where(half == 0)), most)
    trusted = trusted_ids(labels.where(half == 1))
    rows = docs if every else docs.select("doc_id", "lang", "text").join(_sent(trusted), "doc_id", "left_semi")
    scores = scored(rows, stored)
    return Classifier(stored, policy, scores, cut(thresholds(scores, trusted, policy)))


def classify(docs: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(doc_id, lang, n_words, log_p, score, threshold, kept, n_repeats) of every row of docs (doc_id, lang, text).

    score is the log of the perplexity, drawn towards the language's mean. Languages with too few trusted documents, and a
    null lang, are judged by the threshold of all trusted documents. A null text is empty; a text without words has the mean
    score and is kept. Without any trusted documents nothing is rejected and score and threshold are null. labels (doc_id,
    quality, toxic) may repeat; a document is trusted if none of its labels says that it is bad or toxic.
    """
    fitted = fit(docs, labels, policy)
    drop(docs.sparkSession, fitted.stored[0].rpartition("/")[0])  # all documents are scored, and the scores kept
    out = fitted.judged(fitted.scores, "lang", SCORES, ("score", "threshold"))
    kept = F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept")
    return out.select("doc_id", "lang", "n_words", "log_p", "score", "threshold", kept, "n_repeats")


def keep(docs: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The rows of docs that classify() keeps, all columns. Rows are scored where they are read, so no text moves; before that only
    the trusted documents are, for the thresholds."""
    fitted = fit(docs, labels, policy, every=False)
    names, out = tuple(_free(f"{c}_", docs.columns) for c in SCORES), tuple(_free(f"{c}_", docs.columns) for c in ("score", "threshold"))
    rows = fitted.judged(_with_scores(docs, fitted.stored, names), "lang", names, out)
    return rows.where(F.coalesce(F.col(out[0]) <= F.col(out[1]), F.lit(True))).select(*(F.col(f"`{c}`") for c in docs.columns))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
