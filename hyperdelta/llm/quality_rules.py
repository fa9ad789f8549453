"""Quality rules as a ledger: measured once, failures kept as bits, policies and ablations applied later.

The ledger holds a row for each document with its measurements and a bit for each rule that it fails. A policy is a version
and a mask of the rules that reject; applying one, or asking what each rule does alone, is arithmetic on the bits and reads no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, hash_long, prepare, runs, starts_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Each rule's bit is its place; a document fails a rule if the SQL condition on its measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 3",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("v1", BASE), Policy("v2", (*BASE, "symbols")), Policy("v3", tuple(RULES)))}
CURRENT = "v3"


def repeated_words(lists: list[np.ndarray]) -> np.ndarray:
    """Of each text, given as its words' hashes: words in windows of WINDOW words that occur twice or more in it."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate(lists) if lists else np.zeros(0, U64)
    if len(flat) < WINDOW:
        return np.zeros(len(lists), np.int64)
    owner = np.repeat(np.arange(len(lists)), n)
    last = starts_of(n)[1:][owner]
    size = len(flat) - WINDOW + 1
    key = hash_long(owner[:size].astype(U64), 42)
    for k in range(WINDOW):
        key = hash_long(flat[k : k + size], key)
    at = np.flatnonzero(np.arange(size) + WINDOW <= last[:size])
    key = key[at]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(lists))


def measure(contents: list[str], known: WordHashes) -> np.ndarray:
    """A row for each text, a column for each of MEASURES."""
    out = np.zeros((len(contents), len(MEASURES)), np.int64)
    raw = [t.encode("utf-8", "replace") for t in contents]
    for s in runs(raw):
        lists = []
        for i in range(s.start, s.stop):
            words = raw[i].split()
            lists.append(known.of(words))
            white = len(raw[i]) - sum(map(len, words))
            lines = [x for x in raw[i].split(b"\n") if x.strip()]
            symbols = len(raw[i]) - len(raw[i].translate(None, SYMBOLS))
            out[i, :5] = len(words), len(contents[i]) - white, symbols, len(lines), len(lines) - len(set(lines))
        out[s, 5] = repeated_words(lists)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed): failed has the bit of each rule of RULES that the row's whole text fails.

    Words are runs of characters other than ASCII white space. A null text has none. Repeated rows have a row each.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            values = measure([t or "" for t in batch.column(1).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in values.T)], ["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"if({rule}, {1 << i}L, 0L)" for i, rule in enumerate(RULES.values()))
    return measured.withColumn("failed", F.expr(bits))


def judge(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    base = Policy("base", BASE).mask
    return rows.withColumns(
        {
            "base_failed": F.expr(f"failed & {base}L") != 0,
            "kept": F.expr(f"failed & {base | policy.mask}L") == 0,
            "policy": F.lit(policy.version),
        }
    )


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """(policy, rule, n_failed, n_only): documents that each rule of a policy rejects, and that only it rejects.

    Documents are first counted by their masked bits, at most one row for each set of rules.
    """
    sets = rows.groupBy(F.expr(f"failed & {policy.mask}L").alias("bits")).count()
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules)))
    each = sets.select("bits", "count", rules.alias("r"))
    failed, only = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("count")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("count")).otherwise(0)).alias("n_only")
    )


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i,
  unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS s FROM w WHERE len(words) >= 8),
dup AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(8) AS r(k) WHERE c > 1 GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS u FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_lines,
    coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines l USING (rid) LEFT JOIN cover c USING (rid)),
f AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {Policy("base", BASE).mask} <> 0 AS base_failed,
  failed & {Policy("base", BASE).mask | POLICIES[CURRENT].mask} = 0 AS kept, n_lines, failed, '{CURRENT}' AS policy
FROM f
"""
