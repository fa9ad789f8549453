import random

import pytest
from hyperdelta.llm import decontaminate as D

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def exhaustive(rule, items, contents):
    """Every passage against every item by BM25 over all terms, then the same verification."""
    index = D.Index(items, rule)
    df, n, mean = D.document_frequencies([D.words(q) for _, q, _ in items])
    out = set()
    for t, content in enumerate(contents):
        tokens = D.words(content)
        half = rule.window // 2
        for at in range(0, max(1, len(tokens) - half), half) if tokens else ():
            passage = set(tokens[at : at + rule.window])
            for k, (item, question, _) in enumerate(items):
                own = D.words(question)
                weight = {w: D.np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (f := own.count(w)) * (rule.k1 + 1) / (f + rule.k1 * (1 - rule.b + rule.b * len(own) / mean)) for w in set(own)}
                if sum(x for w, x in weight.items() if w in passage) >= rule.score * sum(weight.values()) * min(1, half / len(own)):
                    around = D.shingles(tokens[max(0, at - len(own)) : at + rule.window + len(own)], rule.shingle)
                    if all(len(p & around) >= rule.overlap * len(p) for p in index.parts[k][:2]):
                        out.add((t, item))
    return out


def test_search_is_exhaustive():
    items = [(i, text(RNG.choice([24, 30, 60, 150])), None) for i in range(70)]
    contents = []
    for i in range(80):
        body = [text(RNG.randrange(300)) for _ in range(2)]
        if i % 2:
            words = RNG.choice(items)[1].split()
            for _ in range(RNG.randrange(3)):
                words[RNG.randrange(len(words))] = "changed"
            body.insert(1, " ".join(words))
        contents.append(" ".join(body))
    rule = D.Rule(block=4)
    index = D.Index(items, rule)
    found = {(t, index.ids[k]) for t, k, *_ in D.search_batch(index, [c.encode() for c in contents])}
    assert found == exhaustive(rule, items, contents) and len(found) > 20


def test_question_and_answer_both_count(spark, documents):
    q, a, other = text(30), text(12), text(12)
    items = spark.createDataFrame([(1, q, a)], "item_id long, question string, answer string")
    docs = documents([(1, f"{text(50)} {q} {a} {text(90)}"), (2, f"{text(50)} {q} {other}"), (3, f"{other} {a}"), (4, f"{q.upper()}!! {a}.")])
    assert sorted(r["doc_id"] for r in D.contaminated(docs, items).collect()) == [1, 4]


def test_edges(spark, edge, documents, monkeypatch):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (None, text(30)), (5, "same text here"), (6, "same text here")], "item_id long, text string")
    rows = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(edge, items).collect())
    assert rows == [(4, 5), (4, 5), (4, 6), (4, 6), (5, 5), (5, 6)]
    monkeypatch.setattr(D, "INDEX_CHARS", 10)  # in shards
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(edge, items).collect()) == rows
    clean = D.decontaminate(edge, items)
    assert clean.columns == edge.columns and clean.count() == edge.count() - 3
    assert D.contaminated(edge, items.limit(0)).count() == 0 and D.contaminated(documents([]), items).count() == 0


@pytest.mark.parametrize("length", [20, 59, 64, 100, 300])
def test_items_are_found_wherever_they_stand(length):
    item = text(length)
    index = D.Index([(1, item, None), (2, text(40), None)], D.Rule())
    for before in range(0, 140, 9):
        assert any(k == 0 for _, k, *_ in D.search_batch(index, [f"{text(before)} {item} {text(200)}".encode()]))


def test_shards_do_not_change_results(spark, documents, monkeypatch):
    """400 items in one index and in about sixteen: the same rows, scores and all."""
    items = [(i, text(RNG.choice([10, 24, 60])), None if i % 3 else text(8)) for i in range(400)]
    contents = []
    for i in range(60):
        words = RNG.choice(items)[1].split()
        for _ in range(RNG.randrange(4)):
            words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
        contents.append((i, f"{text(RNG.randrange(200))} {' '.join(words)} {text(RNG.randrange(90))}"))
    df = spark.createDataFrame(items, "item_id long, question string, answer string")
    rule = D.Rule(overlap=0.0)  # retrieval alone
    rows = lambda: sorted(map(tuple, D.contaminated(documents(contents), df, rule).collect()))
    one = rows()
    monkeypatch.setattr(D, "INDEX_CHARS", sum(len(q) + len(a or "") for _, q, a in items) // 16)
    assert len(list(D._indexes(df, rule))) >= 16 and rows() == one and len(one) > 60
    monkeypatch.setattr(D, "CELLS", 1)
    assert rows() == one


def test_parts_of_items():
    """Question and answer by hand, apart from the index."""
    rule = D.Rule()
    q = "one two three four five six seven eight"
    assert D.Index([(1, q, None), (2, "a b", "C-d"), (3, "x", None), (4, None, "y")], rule).parts == [
        ({tuple(w.encode() for w in q.split()[i : i + 5]) for i in (0, 1)}, {(b"seven", b"eight")}, 8),
        ({(b"a", b"b")}, {(b"c", b"d")}, 4), (set(), {(b"x",)}, 1), (set(), {(b"y",)}, 1),
    ]
