import collections
import math
import random

import numpy as np
import pytest
from hyperdelta.llm import kneser_ney as K
from hyperdelta.llm.common import WordHashes, hash_long


class Plain:
    """Interpolated modified Kneser-Ney by its formulas, on counters."""

    def __init__(self, texts):
        self.c3 = collections.Counter()
        for t in texts:
            w = ["", "", *t.split()]
            self.c3.update(tuple(w[i - 2 : i + 1]) for i in range(2, len(w)))
        self.c2 = collections.Counter((b, c) for _, b, c in self.c3)
        self.c1 = collections.Counter(c for _, c in self.c2)
        self.d = [K._discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (self.c1, self.c2, self.c3)]
        self.total = sum(self.c1.values())
        self.rest = sum(self.less(0, v) for v in self.c1.values()) / self.total / (len(self.c1) + 1)

    def less(self, order, count):
        return self.d[order][min(count, 3) - 1]

    def p1(self, w):
        return (self.c1[w] - self.less(0, self.c1[w])) / self.total + self.rest if w in self.c1 else self.rest

    def _p(self, counts, order, context, w, lower):
        own = [n for k, n in counts.items() if k[:-1] == context]
        if not own:
            return lower
        n = counts.get((*context, w), 0)
        return ((n - self.less(order, n) if n else 0) + sum(self.less(order, x) for x in own) * lower) / sum(own)

    def log_p(self, text):
        w, out = ["", "", *text.split()], 0.0
        for i in range(2, len(w)):
            p2 = self._p(self.c2, 1, (w[i - 1],), w[i], self.p1(w[i]))
            out += math.log(self._p(self.c3, 2, (w[i - 2], w[i - 1]), w[i], p2))
        return out


def test_against_the_formulas(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("xy" * (i % 3) + "z") for _ in range(rng.randrange(40))) for i in range(60)]
    model, plain = K.train(spark.createDataFrame([(t,) for t in texts], "text string")), Plain(texts)
    tried = [*texts[:20], "ax bz qq ax", "", "qq", "zz az bz cz", "ax"]
    n, got = K.score_batch(model, [t.encode() for t in tried], WordHashes())
    assert n.tolist() == [len(t.split()) for t in tried]
    np.testing.assert_allclose(got, [plain.log_p(t) for t in tried], rtol=1e-4, atol=1e-4)


def test_hashes_are_sparks(spark):
    row = spark.range(1).selectExpr("xxhash64('é b') AS a", "xxhash64(5L, -7L) AS b", "xxhash64('') AS c").first()
    assert WordHashes()["é b".encode()] == row["a"] and row["c"] == K.BEGIN
    assert int(hash_long(np.array([-7]).view(np.uint64), hash_long(np.array([5], np.uint64), 42)).view(np.int64)[0]) == row["b"]


def test_held_out_accuracy(spark):
    """On labels that neither the sample nor the thresholds saw: junk goes, good documents stay."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    seen, unseen = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    kept = K.classify(docs, seen).select("doc_id", "kept")
    rows = kept.join(unseen, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 50 and sum(good) >= 0.97 * len(good)
    assert len(bad) > 5 and sum(bad) <= 0.35 * len(bad)


@pytest.fixture
def labelled(spark, documents):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(120)] + [(1000 + i, " ".join(f"junk{rng.random()}" for _ in range(60))) for i in range(10)]
    labels = [(i, 1, 0) for i in range(100)] + [(5, 1, 0), (None, 1, 0), (3, None, None), (2000, 1, 0)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rejects_and_keeps(labelled):
    docs, labels = labelled
    kept = {r["doc_id"]: r["kept"] for r in K.classify(docs, labels).collect()}
    assert len(kept) == 130 and all(kept[i] for i in range(120)) and not any(kept[1000 + i] for i in range(10))
    out = K.keep(docs, labels)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(120))


def test_edges(spark, labelled, edge, documents):
    docs, labels = labelled
    rows = {r["doc_id"]: r for r in K.classify(docs.unionByName(edge.withColumn("doc_id", edge["doc_id"] + 5000).withColumn("lang", edge["text"].substr(1, 0))), labels).collect()}
    assert rows[5001]["n_words"] == 0 and rows[5001]["kept"] and rows[5001]["score"] == rows[5002]["score"]
    assert K.classify(documents([(1, "a b")], lang=None), labels).first()["kept"]
    none = labels.limit(0)
    got = K.classify(edge, none).collect()
    assert len(got) == edge.count() and all(r["kept"] and r["threshold"] is None for r in got)
    assert K.keep(edge, none).count() == edge.count()
    assert K.classify(documents([]), labels).count() == 0 and K.keep(documents([]), labels).count() == 0


def test_all_trusted_documents_are_counted(spark):
    """More of them than the former sample of 2,500 documents had, and parts of a model say together what the whole says."""
    docs = spark.createDataFrame([(i, f"only{i} seen{i} once{i % 7}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    trusted = K.training_texts(docs, labels)
    assert trusted.count() == 3000
    whole, (words, *parts) = K.train(trusted), map(K.load, K.store(trusted, 2500))
    for p in parts:
        p.words = words
    assert len(parts) > 2 and len(whole.triples.keys) == sum(len(p.triples.keys) for p in parts) == 9000
    tried = [f"only{i} seen{i} once{i % 7} x".encode() for i in range(0, 3100, 50)] + [b"", b"once1", b"only3 only4"]
    got = sum(K.score_batch(p, tried, WordHashes())[1] for p in parts)
    np.testing.assert_allclose(got, K.score_batch(whole, tried, WordHashes())[1], rtol=1e-5, atol=1e-5)


def test_scores_do_not_depend_on_parts(spark, labelled):
    docs, labels = labelled
    one, many = K.fit(docs, labels), K.fit(docs, labels, most=500)
    assert len(one.stored) == 2 and len(many.stored) > 3
    a, b = ({r["doc_id"]: r["log_p"] for r in f.scores.collect()} for f in (one, many))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-5) for i in a)


def test_frequent_words_are_split(spark):
    """Words that would fill a part are dealt out by two words; the formulas hold all the same."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["the", "of", "the", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(2, 60))) for _ in range(80)]
    stored = K.store(spark.createDataFrame([(t,) for t in texts], "text string"), 200)
    words, *parts = map(K.load, stored)
    plain = Plain(texts)
    assert len(words.frequent) >= 2 and len(parts) > 5
    tried = [*texts[:15], "the of the", "of of of of w3", "qq the qq of", "", "w1"]
    got = 0
    for p in parts:
        p.words = words
        got = got + K.score_batch(p, [t.encode() for t in tried], WordHashes())[1]
    np.testing.assert_allclose(got, [plain.log_p(t) for t in tried], rtol=1e-4, atol=1e-4)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000))
    whole = K._build([], np.zeros(0, np.uint64)) and list(K._sequences(iter([K.pa.RecordBatch.from_pydict({"t": [text]})])))
    monkeypatch.setattr(K, "COUNTED", 64)
    pieces = list(K._sequences(iter([K.pa.RecordBatch.from_pydict({"t": [text, "a"]})])))
    triples = lambda xs: sorted((*s[i - 2 : i + 1].tolist(),) for s, c in xs for i in np.flatnonzero(c))
    extra = triples(list(K._sequences(iter([K.pa.RecordBatch.from_pydict({"t": ["a"]})]))))
    assert len(pieces) > 10 and triples(pieces) == sorted(triples(whole) + extra)


def test_repeats():
    texts = ["a b c a b c", "a a a a a", "", "a b", "x y z w", "a b c"]
    n, hashes = K._hashed([t.encode() for t in texts], WordHashes())
    want = [sum(w[i - 2 : i + 1] in [w[j - 2 : j + 1] for j in range(2, i)] for i in range(2, len(w))) for w in (t.split() for t in texts)]
    assert K.repeats(n, hashes).tolist() == want == [1, 2, 0, 0, 0, 0]


def test_thresholds_and_verdicts_by_the_formulas(spark, labelled):
    """From the log-probabilities on, by hand: rates, means, quantiles, scores and verdicts, by language."""
    docs, labels = labelled
    docs = docs.withColumn("lang", K.F.expr("CASE WHEN doc_id % 3 = 0 THEN 'de' WHEN doc_id % 50 = 1 THEN 'xx' WHEN doc_id % 50 = 2 THEN NULL ELSE 'en' END"))
    policy = K.Policy()
    rows = {r["doc_id"]: r for r in K.classify(docs, labels, policy).collect()}
    trusted = {r["doc_id"] for r in K.trusted_ids(labels).where(K.F.expr("pmod(xxhash64(doc_id, 'half'), 2) = 1")).collect()} & rows.keys()

    def limits(ids):
        n, again, log_p = (sum(rows[i][c] for i in ids) for c in ("n_words", "n_repeats", "log_p"))
        rate = (again + 1) / (n + 2)
        cost = lambda r: -(r["log_p"] + r["n_repeats"] * math.log(rate) + (r["n_words"] - r["n_repeats"]) * math.log(1 - rate))
        mean = sum(cost(rows[i]) for i in ids) / n
        score = lambda r: (policy.prior * mean + cost(r)) / (policy.prior + r["n_words"])
        order = sorted(score(rows[i]) for i in ids)
        at = lambda q: order[max(0, math.ceil(q * len(order)) - 1)]
        return score, at(policy.quantile) + policy.margin * (at(policy.quantile) - at(0.5))

    together = limits([i for i in trusted if rows[i]["n_words"]])
    for lang in ("en", "de", "xx", None):
        mine = [i for i in trusted if lang and rows[i]["lang"] == lang]
        score, threshold = limits(mine) if len(mine) >= policy.least_trusted else together
        for r in rows.values():
            if r["lang"] == lang:
                assert math.isclose(r["score"], score(r), rel_tol=1e-6) and math.isclose(r["threshold"], threshold, rel_tol=1e-6)
                assert r["kept"] == (r["score"] <= r["threshold"])


def test_a_text_that_repeats_itself_goes(labelled, documents, spark):
    """Of words that are all likely by themselves."""
    docs, labels = labelled
    more = docs.unionByName(documents([(3000, "w1 w2 w3 w4 " * 40), (3001, "w7 " * 100)]))
    kept = {r["doc_id"]: r["kept"] for r in K.classify(more, labels).collect()}
    assert not kept[3000] and not kept[3001] and all(kept[i] for i in range(120))


def test_labels_that_disagree(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, 1, 0), (3, None, None), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["doc_id"] for r in K.trusted_ids(labels).collect()] == [3]


def test_clashing_names_pass_through(labelled):
    docs, labels = labelled
    for name in ("n_words_", "score_", "_row", "_of", "_lang", "rate", "mean_"):
        docs = docs.withColumn(name, K.F.lit(name))
    out = K.keep(docs, labels)
    assert out.columns == docs.columns and out.count() == 120 and out.first()["_row"] == "_row"


def test_a_task_builds_one_part(spark, monkeypatch):
    """By a hash of the part several met in one task. Nor does Spark write files on the way, each of which starts a process beside the executor."""
    rng = random.Random(17)
    texts = spark.createDataFrame([(" ".join(f"w{rng.randrange(300)}" for _ in range(60)),) for _ in range(100)], "text string")
    seen, plain = [], type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, *a, **b: seen.append(self) or plain(self, *a, **b))
    monkeypatch.setattr(type(texts), "write", property(lambda self: pytest.fail("Spark writes files")))
    _, *parts = K.store(texts, 200)
    monkeypatch.undo()
    dealt = next(df for df in seen if df.columns == ["part", "data"])
    met = dealt.groupBy(K.F.spark_partition_id()).agg(K.F.count_distinct("part").alias("n")).collect()
    assert len(parts) == 30 and len(met) > 20 and all(r["n"] == 1 for r in met)


def test_words_in_shards(spark, monkeypatch):
    """The words and the pairs of frequent words, dealt over several tables, say what one table says."""
    rng = random.Random(19)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(200)}"]) for _ in range(40)) for _ in range(60)]
    docs, plain = spark.createDataFrame([(t,) for t in texts], "text string"), Plain(texts)
    monkeypatch.setattr(K, "WORDS", 40)
    words, *parts = map(K.load, K.store(docs, 300))
    assert len(words.files) > 4 and len(words.pairs) > 4 and len(words.frequent) >= 2
    tried = [*texts[:15], "the of the", "qq the qq of", "", "w1"]
    got = 0
    for p in parts:
        p.words = words
        got = got + K.score_batch(p, [t.encode() for t in tried], WordHashes())[1]
    np.testing.assert_allclose(got, [plain.log_p(t) for t in tried], rtol=1e-4, atol=1e-4)


def test_scores_are_files_of_the_workers(spark, labelled):
    """Narrow rows, of any kind of language column, that a lost executor does not take along."""
    docs, labels = labelled
    for lang in (K.F.col("lang"), K.F.lit(None), K.F.lit(3)):
        rows = docs.withColumn("lang", lang)
        scores = K.fit(rows, labels).scores
        assert scores.inputFiles() and scores.columns == ["doc_id", "lang", "n_words", "n_repeats", "log_p"]
        assert sorted(r["doc_id"] for r in scores.collect()) == sorted(r["doc_id"] for r in docs.collect())
        assert K.classify(rows, labels).where("NOT kept").count() == 10
