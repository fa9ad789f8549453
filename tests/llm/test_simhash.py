import random

import numpy as np
import pytest
import xxhash
from hyperdelta.llm import simhash


def plain(text):
    """A fingerprint by the definition, bit by bit."""
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Of (id, fingerprint) pairs: each row's least reachable id, from all pairs."""
    at = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                a, b = at[i], at[j]
                at = [b if x == a else x for x in at]
    least = {}
    for (id, _), g in zip(prints, at):
        least[g] = min(x for x in (least.get(g), id) if x is not None) if (least.get(g) is not None or id is not None) else None
    return [least[g] for g in at]


@pytest.mark.parametrize("text", ["", "a", "A b", "one two three", "One TWO three Four five", "a a a a a a", "É é x\x1cy z w", "w " * 1000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_anchors_cover_every_pair():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.sample(range(64), rng.randrange(4)):
            b[i] ^= np.uint64(1 << bit)
    row_a, key_a, home = simhash.anchors(a)
    homes = {(r, k) for r, k, h in zip(row_a, key_a, home) if h}
    row_b, key_b, _ = simhash.anchors(b)
    there = set(zip(row_b, key_b))
    assert len(homes) == 2 * len(a) and all(any((i, k) in there for r, k in homes if r == i) for i in range(len(a)))
    assert len(row_a) <= 34 * len(a)


def test_groups_against_all_pairs(documents):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(120)).split() for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "new"
        rows.append((i * 3, " ".join(words)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = [(i, plain(t)) for i, t in rows]
    assert {i: (f"{f:016x}", c) for (i, f), c in zip(prints, groups(prints))} == got


def test_a_large_bucket_keeps_its_links(spark):
    """Many fingerprints at one anchor: a forest, with the components of all pairs."""
    rng = random.Random(3)
    prints = sorted({rng.getrandbits(32) << 32 | 5 if rng.random() < 0.2 else (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(prints)], "fp long, node long")
    from hyperdelta.llm.graph import components

    found = {r["node"]: r["component"] for r in components(simhash.links(nodes)).collect()}
    want = groups(list(enumerate(prints)))
    assert [found.get(i, i) for i in range(len(prints))] == want


def test_edges(edge, documents):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()]
    assert len(got) == edge.count()
    of = {i: (f, c) for i, f, c in got}
    assert of[1] == of[2] == of[3] == ("0" * 16, 1) and of[4] == of[5] and of[4][1] == 4
    assert next(c for i, _, c in got if i is None) is None
    assert simhash.near_duplicates(documents([])).count() == 0
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    assert simhash.deduplicate(documents([])).count() == 0


def test_chains_reach_across(spark):
    from hyperdelta.llm.graph import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_a_crowded_anchor(spark):
    """Twenty thousand fingerprints near one half: the same groups as all pairs, without comparing each with all."""
    rng = random.Random(4)
    near = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(32), n))
    for half in (0, 1):
        prints = sorted({near(5, rng.randrange(2)) << 32 * half | (near(9, rng.randrange(7)) if rng.random() < 0.02 else rng.getrandbits(32)) << 32 * (1 - half) for _ in range(3000)})
        row, anchor, home = simhash.anchors(np.array(prints, np.uint64))
        key, n = np.unique(anchor, return_counts=True)
        key = key[(key >> 40 == half)][n[key >> 40 == half].argmax()]
        at = anchor == key
        fp, home = np.array(prints, np.uint64)[row[at]], home[at]
        assert len(fp) > 2000
        node, least = simhash._forest(fp, np.arange(len(fp)), home, 3, half)
        label = np.arange(len(fp))
        for i in np.flatnonzero(home):
            found = np.unique(label[np.bitwise_count(fp ^ fp[i]) <= 3])
            label[np.isin(label, found)] = found[0]
        assert len(np.unique(label)) < len(fp) and (least == label).all()


def test_one_id_with_several_texts(spark, documents):
    """Texts of one id that do not resemble each other stay apart; rows without an id join what they resemble."""
    a, b, c = ("alpha beta gamma " * 30, " ".join(f"x{i}" for i in range(90)), " ".join(f"y{i % 40}" for i in range(200)))
    rows = documents([(1, a), (5, a), (5, b), (5, c), (7, b), (7, c), (9, c)])
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    prints = {t: f"{simhash.fingerprint(t.encode()):016x}" for t in (a, b, c)}
    assert got == {(1, prints[a]): 1, (5, prints[a]): 1, (5, prints[b]): 5, (5, prints[c]): 5, (7, prints[b]): 5, (7, prints[c]): 5, (9, prints[c]): 5}
    assert sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(rows).collect()) == sorted([(1, a), (5, b), (5, c)])
    # two texts that link to each other only through one without an id
    base = np.uint64(0x0123456789ABCDEF)
    nodes = spark.createDataFrame([(int(base), int(base)), (int(base) ^ 7, int(base) ^ 7), (int(base) ^ 63, int(base) ^ 63)], "fp long, node long")
    from hyperdelta.llm.graph import components

    assert len({r["component"] for r in components(simhash.links(nodes)).collect()}) == 1


def test_columns_pass_through_whatever_their_names(documents):
    from pyspark.sql import functions as F

    rows = documents([(1, "one two three four"), (1, "one two three four"), (2, "other words are here")])
    for i, name in enumerate(("_row", "_kept", "_id", "_text", "_hash", "_place", "text_hash", "component", "a.b")):
        rows = rows.withColumn(name, F.lit(i))
    got = simhash.deduplicate(rows)
    assert got.columns == rows.columns
    assert sorted(tuple(r)[-9:] for r in got.collect()) == [tuple(range(9))] * 2


def test_of_rows_that_differ_elsewhere_one_stays_for_certain(documents):
    from pyspark.sql import functions as F

    rows = documents([(1, "one two three four")] * 6).withColumn("n_chars", F.monotonically_increasing_id())
    assert len({simhash.deduplicate(rows.repartition(n)).first()["n_chars"] for n in (1, 2, 3)}) == 1
