"""Personal data: base patterns, and a skip-chain conditional random field that carries their labels to what they miss.

The field's nodes are a document's candidate tokens: runs without white space that hold a digit or an at sign. Unary factors
score a token's form and context for each label; chain factors join candidates a few words apart; skip factors join each
candidate to the one before it with the same or a similar form (alike without case and punctuation), however distant, so a
form that repeats k times has k - 1 factors. Tokens under a base match are observed. Loopy sum-product message passing over a
whole batch of documents, vectorised over all edges, gives every other token its label's probability.

Unary weights (multinomial logistic regression), chain potentials (smoothed log-odds) and the skip potential (log-odds of
agreement) are trained piecewise on a bounded sample of documents, labelled by the base patterns and by assignments to
names like token or key; the features leave out what those rules test, so far as the form alone goes.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, runs, starts_of

#: Kinds and their patterns.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run's later digits cannot match where its first does not
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ASSIGNED = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|key|password|passwd)\s*[=:]\s*[\"']?([A-Za-z0-9+/_=-]{16,})")
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0d])[^\x20\x09-\x0d]*[0-9@][^\x20\x09-\x0d]*")
EDGE = "\"'`!*#&%$|.,;:()<>[]{}=?"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and without overlap in each kind, in time proportional to the text."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass(frozen=True)
class Settings:
    """sample: documents to train on, the first by the hash of their id; tokens: candidate tokens of them, in that order; share: the most
    that one document adds, spread over it. reach: words between chain neighbours. sure: least probability of an added span's label."""

    sample: int = 3000
    tokens: int = 20_000
    share: int = 500
    reach: int = 4
    rounds: int = 12
    sure: float = 0.9


@dataclass
class Nodes:
    """Candidates of one text, in order."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[tuple[float, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # observed; -1 if none, len(KINDS) for "other" in training
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


N_FEATURES = 22


def features(core: str, before: str) -> tuple[float, ...]:
    """Of a token without its edges, and the text just before it."""
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in core)
    dots, n = core.count("."), max(1, len(core))
    size = [0.0] * 6
    size[min(5, len(core) // 6)] = 1.0
    return (
        1, "@" in core, dots == 3, dots > 0, digits / n, letters / n, hexes / n == 1, *size, len(set(core.lower())) >= 10, digits >= 4 and letters >= 4,
        core[:1] == "+", "-" in core, before.rstrip(" \"'").endswith(("=", ":")), before.endswith(('"', "'")),
        13 <= digits <= 19 and not letters, bool(digits) and digits == n, "+" in before[-6:],
    )


def candidates(text: str, spans: list[Span], settings: Settings, seeds: bool = False) -> Nodes:
    out = Nodes()
    if not ("@" in text or DIGIT.search(text)):
        return out
    secret = sorted((m.start(1), m.end(1)) for m in ASSIGNED.finditer(text)) if seeds else []
    last: dict[str, int] = {}
    previous_end, k, s = -1, 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        token = m[0]
        left = len(token) - len(token.lstrip(EDGE))
        core = token.strip(EDGE)
        if not core:
            continue
        a, b = a + left, a + left + len(core)
        i = len(out.spans)
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        over = next((x for x in itertools.takewhile(lambda x: x[0] < b, itertools.islice(spans, k, None)) if x[2] > a), None)
        while s < len(secret) and secret[s][1] <= a:
            s += 1
        label = over[1] if over else 4 if s < len(secret) and secret[s][0] < b else len(KINDS) if seeds else -1
        out.spans.append((a, b))
        out.features.append(features(core, text[max(0, a - 12) : a]))
        out.label.append(label)
        if i and previous_end >= 0 and text.count(" ", previous_end, min(a, previous_end + 200)) <= settings.reach and a - previous_end < 200:
            out.chain.append((i - 1, i))
        form = "".join(c for c in core.lower() if c.isalnum() or c == "@")
        if form:
            if form in last:
                out.skip.append((last[form], i))
            last[form] = i
        previous_end = b
    if seeds:  # what is assigned to a name somewhere is as secret where it stands alone
        for i, j in out.skip:
            if out.label[i] == 4 and out.label[j] == len(KINDS):
                out.label[j] = 4
        for i, j in reversed(out.skip):
            if out.label[j] == 4 and out.label[i] == len(KINDS):
                out.label[i] = 4
    return out


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log
    skip: float


def train(samples: Iterable[str], settings: Settings = Settings()) -> Field:
    """Piecewise: each kind of factor by itself. Without candidates, unary factors are flat and nothing is added. A document with more
    than its share of tokens gives that many, evenly spaced, and the factors between tokens that it gives."""
    labels = len(KINDS) + 1
    x, y, chain, agree, total = [], [], np.full((labels, labels), 0.5), 1.0, 2.0
    for text in samples:
        nodes = candidates(text, base_spans(text), settings, seeds=True)
        n = min(len(nodes.spans), settings.share, settings.tokens - len(x))
        given = {i * len(nodes.spans) // n for i in range(n)}
        x += [nodes.features[i] for i in sorted(given)]
        y += [nodes.label[i] for i in sorted(given)]
        for i, j in nodes.chain:
            if i in given and j in given:
                chain[nodes.label[i], nodes.label[j]] += 1
        for i, j in nodes.skip:
            if i in given and j in given:
                agree += nodes.label[i] == nodes.label[j]
                total += 1
        if len(x) >= settings.tokens:
            break
    weights = np.zeros((N_FEATURES, labels))
    weights[0, -1] = 2.0
    if x:
        data, target = np.array(x, float), np.eye(labels)[y]
        speed = np.zeros_like(weights)
        for _ in range(400):
            z = data @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 0.5 * (data.T @ (p - target) / len(data) + 2e-4 * weights)
            weights = weights + speed
    joint = chain / chain.sum()
    odds = np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0, keepdims=True))
    share = min(0.98, agree / total)
    return Field(weights, np.clip(odds, -2, 2), float(np.clip(np.log(share / (1 - share)), 0.5, 4)))


def infer(model: Field, documents: list[Nodes], rounds: int) -> np.ndarray:
    """Label probabilities of all nodes of all documents, one after another, by damped loopy sum-product.

    Messages are kept as probabilities, and a potential is applied as one product for all edges of a kind, so memory is a few numbers
    a label for each node and edge.
    """
    at = starts_of(np.array([len(d.spans) for d in documents], np.int64))
    labels = model.weights.shape[1]
    unary = np.concatenate([np.array(d.features, float).reshape(-1, N_FEATURES) @ model.weights for d in documents])
    unary -= np.logaddexp.reduce(unary, axis=1)[:, None]
    observed = np.concatenate([np.array(d.label, np.int64) for d in documents])
    fixed = np.flatnonzero(observed >= 0)
    unary[fixed] = -30.0
    unary[fixed, observed[fixed]] = 0.0
    pairs = [np.concatenate([np.array(p, np.int64).reshape(-1, 2) + at[n] for n, p in enumerate(x)]) for x in ([d.chain for d in documents], [d.skip for d in documents])]
    belief = unary
    if len(pairs[0]) + len(pairs[1]):
        chain, same = np.exp(model.chain), np.exp(model.skip) - 1
        # forth along chains, back along chains, along skips both ways
        source = np.concatenate([pairs[0][:, 0], pairs[0][:, 1], pairs[1][:, 0], pairs[1][:, 1]])
        target = np.concatenate([pairs[0][:, 1], pairs[0][:, 0], pairs[1][:, 1], pairs[1][:, 0]])
        c, s = len(pairs[0]), len(pairs[1])
        back = np.r_[np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)]
        message = np.zeros((len(source), labels))
        for _ in range(rounds):
            out = belief[source] - message[back]
            out -= out.max(axis=1, keepdims=True)
            np.exp(out, out=out)
            out[:c] = out[:c] @ chain
            out[c : 2 * c] = out[c : 2 * c] @ chain.T
            out[2 * c :] = same * out[2 * c :] + out[2 * c :].sum(axis=1, keepdims=True)
            out /= out.sum(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * np.log(out)
            belief = unary + np.stack([np.bincount(target, message[:, k], len(unary)) for k in range(labels)], axis=1)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])


#: Characters of texts whose fields are solved together; a longer text is solved alone, all of it, as its labels hang together.
TOGETHER = 4 << 20


def find_batch(model: Field, contents: list[str], settings: Settings = Settings()) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, all spans) of each text. Added spans are whole tokens without their edges, and overlap no base span."""
    base, every = [], []
    for s in runs(contents, TOGETHER):
        own = [base_spans(t) for t in contents[s]]
        base += own
        every += _added(model, contents[s], own, settings)
    return base, every


def _added(model: Field, contents: list[str], base: list[list[Span]], settings: Settings) -> list[list[Span]]:
    nodes = [candidates(t, b, settings) for t, b in zip(contents, base)]
    every = [list(b) for b in base]
    some = [i for i, n in enumerate(nodes) if n.spans]
    if some:
        p = infer(model, [nodes[i] for i in some], settings.rounds)
        best, at = p.argmax(axis=1), 0
        for i in some:
            for k, (a, b) in enumerate(nodes[i].spans):
                kind = int(best[at + k])
                if nodes[i].label[k] < 0 and kind < len(KINDS) and p[at + k, kind] >= settings.sure:
                    every[i].append((a, kind, b))
            at += len(nodes[i].spans)
            every[i].sort()
    return every


def fit(docs: DataFrame, settings: Settings = Settings()) -> Field:
    """Trains on the sample, in the order of the hash of the id; at most settings.sample documents' texts come to the driver, one at a time."""
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi").where("text RLIKE '[0-9@]'")
    return train((r["text"] for r in chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator()), settings)


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of docs (doc_id, text).

    Offsets count code points, ends are exclusive. The counts and base_sha256 are of base spans; spans has all. A null text
    is empty: no spans, the digest of an empty string. Repeated rows give the same result each.
    """
    prepare(docs.sparkSession)
    model = fit(docs, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = find_batch(model, [t or "" for t in batch.column(1).to_pylist()], settings)
            counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(len(BASE))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base]),
                 pa.array([joined(s) for s in every]), pa.array([len(e) - len(b) for b, e in zip(base, every)], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """text with each span, and each chain of overlapping ones, as <KIND> of the first."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with personal data masked, and n_chars, where there is one, counted anew for changed texts. Null texts stay null."""
    prepare(docs.sparkSession)
    model = fit(docs, settings)
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            spans = find_batch(model, [t or "" for t in old], settings)[1]
            new = [masked(t, s) if s else t for t, s in zip(old, spans)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                kept = batch.column(size).to_pylist()
                columns[size] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, kept)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
