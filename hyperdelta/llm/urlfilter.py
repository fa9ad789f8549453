"""URL rules by a sort-merge range join over reversed hosts.

A host's key is its labels from last to first, each with a dot behind it, so a rule's host and all its subdomains are one
interval of keys, and intervals nest or are apart. A sweep over the sorted rules, once, keeps a stack of those whose interval it is
in, and so finds for each host the one around it. The urls of a batch are sorted too and merged with the rules, from one url's place
to the next by bisection; the hosts around a place are the sweep's stack there. Of one host's rules the longest path that the url's
starts with is looked up by its lengths, so neither many rules nor many paths of a host are gone through for each url. The rules go
to every task, in blocks of a bounded number; a url keeps its best over the blocks.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Rules that are broadcast at once.
BLOCK = 500_000
#: Verdict of the method on a url that no rule fits.
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, str, bool]:
        """The longest wins; of equally long ones the greatest text; of equal ones the one that blocks."""
        return len(self.text), self.text, self.verdict == "block"


#: Fixed values of the query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or a url without ://."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


@dataclass(frozen=True)
class Hosts:
    """Rules by host, sorted by key. around: of each host the place of the nearest host whose interval it is in, or -1. paths: of each
    host its rules by path. lengths: the lengths of these paths, the longest first."""

    keys: list[str]
    around: list[int]
    paths: list[dict[str, Rule]]
    lengths: list[list[int]]


def sorted_rules(rules: list[Rule]) -> Hosts:
    """Of rules with the same host and path, the one that blocks counts. A rule without a host or a verdict fits nothing; a path that
    is null is empty."""
    by: dict[str, dict[str, Rule]] = {}
    for r in rules:
        if r.host is not None and r.verdict is not None:
            r = r if r.path is not None else Rule(r.host, "", r.verdict)
            own = by.setdefault(key(r.host), {})
            own[r.path] = max(own.get(r.path, r), r, key=lambda x: x.rank)
    keys, around, stack = sorted(by), [], []
    for i, k in enumerate(keys):
        while stack and not k.startswith(keys[stack[-1]]):
            stack.pop()
        around.append(stack[-1] if stack else -1)
        stack.append(i)
    return Hosts(keys, around, [by[k] for k in keys], [sorted({len(p) for p in by[k]}, reverse=True) for k in keys])


def sweep(urls: list[tuple[str, str]], hosts: Hosts) -> list[Rule | None]:
    """The winning rule of each (host, path)."""
    places = [key(host) for host, _ in urls]
    out: list[Rule | None] = [None] * len(urls)
    at = 0
    for i in sorted(range(len(urls)), key=places.__getitem__):
        at = bisect.bisect_right(hosts.keys, places[i], at)
        k, path, fitting = at - 1, urls[i][1], []
        while k >= 0 and not places[i].startswith(hosts.keys[k]):
            k = hosts.around[k]
        while k >= 0:  # every host further around is a prefix too
            own = hosts.paths[k]
            found = next((r for n in hosts.lengths[k] if n <= len(path) and (r := own.get(path[:n]))), None)
            if found:
                fitting.append(found)
            k = hosts.around[k]
        out[i] = max(fitting, key=lambda r: r.rank, default=None)
    return out


def _blocks(pages: DataFrame, rules: DataFrame | tuple[Rule, ...]) -> Iterator[Broadcast]:
    sc = pages.sparkSession.sparkContext
    if isinstance(rules, tuple):
        for i in range(0, len(rules), BLOCK):
            yield sc.broadcast(sorted_rules(list(rules[i : i + BLOCK])))
        return
    n = -(-rules.count() // (BLOCK // 2))  # blocks by hash come out uneven
    for k in range(n):
        part = rules.where(F.expr(f"pmod(xxhash64(host, path), {n})") == k).collect()
        yield sc.broadcast(sorted_rules([Rule(r["host"], r["path"], r["verdict"]) for r in part]))


def judge(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url).

    A rule (host, path, verdict) fits its host and all subdomains, if the url's path starts with the rule's; the longest
    wins. rule is the winner's host and path, null if none fits; then the verdict is DEFAULT. A null url has an empty host
    and path, which no rule fits. Repeated rows of pages have a row each; repeated rules count once. A rule without a host or a
    verdict fits nothing; one without a path has an empty one, which fits all paths.
    """
    prepare(pages.sparkSession)
    schema = "page_id long, host string, path string, rule string, verdict string"
    out = pages.select(F.col("page_id").cast("long"), F.col("url").alias("host"), *(F.lit(None).cast("string").alias(c) for c in ("path", "rule", "verdict")))
    for k, block in enumerate(_blocks(pages, rules)):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block, first: bool = k == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, text, verdict = (c.to_pylist() for c in batch.columns[1:])
                urls = [split(u) for u in a] if first else list(zip(a, b))
                for i, rule in enumerate(sweep(urls, block.value)):
                    if rule and (text[i] is None or rule.rank > (len(text[i]), text[i], verdict[i] == "block")):
                        text[i], verdict[i] = rule.text, rule.verdict
                columns = [batch.column(0), *(pa.array(c, pa.string()) for c in ([u[0] for u in urls], [u[1] for u in urls], text, verdict))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

        out = out.mapInArrow(run, schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
j AS (SELECT p.*, first(rh || rp ORDER BY length(rh || rp) DESC) AS rule, first(r.verdict ORDER BY length(rh || rp) DESC) AS verdict
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM j
"""
