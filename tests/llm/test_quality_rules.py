import random
import re

from hyperdelta.llm import quality_rules as Q
from hyperdelta.llm.common import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), repeated, len(covered)]


def test_measures():
    rng = random.Random(9)
    texts = ["", " \n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x\nx\n x\n\nx", "é\x1c\x85b #|", "w " * 40, "a b c d e f g h i a b c d e f g h"]
    texts += ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é "]) for _ in range(rng.randrange(120))) for _ in range(300)]
    assert Q.measure(texts, WordHashes()).tolist() == [plain(t) for t in texts]


def test_windows_do_not_cross_texts():
    text = "a b c d e f g h"
    assert Q.measure([text, text, text], WordHashes())[:, 5].tolist() == [0, 0, 0]


def test_ledger_policies_and_ablations(edge, documents):
    rows = Q.ledger(edge)
    judged = {r["doc_id"]: r for r in Q.judge(rows, Q.POLICIES["v1"]).collect()}
    assert rows.count() == edge.count() and judged[1]["n_words"] == 0 and judged[1]["base_failed"] and not judged[1]["kept"]
    assert judged[6]["n_repeat_words"] == 60_000 and judged[6]["failed"] & 2
    clean = documents([(1, " ".join(f"word{i}" for i in range(50))), (2, " ".join(f"w{i} |" for i in range(50)))])
    kept = lambda v: {r["doc_id"]: r["kept"] for r in Q.judge(Q.ledger(clean), Q.POLICIES[v]).collect()}
    assert kept("v1") == {1: True, 2: True} and kept("v2") == {1: True, 2: False}
    table = {r["rule"]: (r["n_failed"], r["n_only"]) for r in Q.ablations(rows, Q.POLICIES["v3"]).collect()}
    failed = [r["failed"] for r in rows.collect()]
    for k, rule in enumerate(Q.RULES):
        assert table[rule] == (sum(f >> k & 1 for f in failed), sum(f == 1 << k for f in failed))
    assert Q.judge(Q.ledger(documents([])), Q.POLICIES["v3"]).count() == 0
