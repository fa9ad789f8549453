import hashlib
import random
import re

import numpy as np
from hyperdelta.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_against_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("@.a1+- (-%é\n0") for _ in range(rng.randrange(26)))
        assert pii.base_spans(text) == plain(text)
    for text in ("4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "x 0000300.1.1.1"):
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_no_square_time():
    for c in ("a", "1", "1.", "+1", "a@", "1 ", "9"):
        pii.candidates(t := c * 200_000, pii.base_spans(t), pii.Settings())


def corpus():
    rng = random.Random(6)
    out = []
    for i in range(300):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        parts = ["plain words here and there"] * 3
        parts += [f'token = "{secret}" then', f"mail me at user{i}@mail.example.org or so", f"in {rng.randrange(1990, 2024)} we saw {rng.randrange(50)} things", f"host 10.0.{i % 250}.7 is up"]
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return out


MODEL = pii.train(corpus())


def test_labels_spread_to_repeated_tokens():
    secret = "9f" * 10 + "0123456789abcdefab12"
    text = f'the token = "{secret}" was set. ' + "words " * 3000 + f"later {secret} came up again, in 1999 and 7 times"
    _, every = pii.find_batch(MODEL, [text])
    found = [(text[a:b], pii.KINDS[k]) for a, k, b in every[0]]
    assert found == [(secret, "secret"), (secret, "secret")]
    assert pii.find_batch(MODEL, ["in 1999 we saw 12 things and 3 more, " * 20])[1] == [[]]


def test_message_passing_is_exact_on_trees():
    """Against summing over all labellings of a small chain with a skip edge that closes no loop."""
    nodes = pii.candidates("a1 b2 c3", [], pii.Settings())
    nodes.skip = []
    got = pii.infer(MODEL, [nodes], 40)
    k = MODEL.weights.shape[1]
    unary = np.array(nodes.features) @ MODEL.weights
    unary -= np.logaddexp.reduce(unary, axis=1)[:, None]
    joint = unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + MODEL.chain[:, :, None] + MODEL.chain[None, :, :]
    p = np.exp(joint - np.logaddexp.reduce(joint.ravel()))
    assert nodes.chain == [(0, 1), (1, 2)] and k == len(pii.KINDS) + 1
    np.testing.assert_allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-4)


def test_edges(edge, documents, spark):
    rows = pii.find(edge).collect()
    assert len(rows) == edge.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_email"], r["base_sha256"], r["spans"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, empty, "")}
    assert pii.find(documents([])).count() == 0
    docs = documents([(1, "é mail a@b.co, call +1 (743) 555-3824!"), (2, None), (3, "nothing")])
    done = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(docs).collect()}
    assert done == {1: ("é mail <EMAIL>, call <PHONE>!", len("é mail <EMAIL>, call <PHONE>!")), 2: (None, None), 3: ("nothing", 7)}
    assert pii.redact(docs).columns == docs.columns and pii.redact(documents([])).count() == 0


def test_overlapping_spans_are_masked_once():
    assert pii.masked("abcdef", [(0, 0, 3), (2, 1, 4), (5, 3, 6)]) == "<EMAIL>e<PHONE>"


def test_long_numbers_in_addresses():
    zeros = "0" * 5000
    for text, found in ((f"{zeros}1.2.3.4", True), (f"1.2.3.{zeros}", True), (f"1.2.3.{zeros}256", False), ("1" * 5000 + ".2.3.4", False)):
        assert [k for _, k, _ in pii.base_spans(text)] == [1] * found


def test_a_token_under_many_spans_is_observed():
    """However many base spans lie in one run, or before it."""
    run = ",".join(f"10.0.0.{i}" for i in range(60))
    text = f"{run} and {run}"
    nodes = pii.candidates(text, pii.base_spans(text), pii.Settings())
    assert len(nodes.spans) == 2 and nodes.label == [1, 1]
    text = "+1 2 3 4 5 6 7 8 9 0 a1@b.cd " + "1.2.3.4," * 20 + "x9"
    assert set(pii.candidates(text, pii.base_spans(text), pii.Settings()).label) <= {0, 1, 2, 3}


def exact(model, nodes):
    """Marginals by summing over all labellings."""
    n, k = len(nodes.spans), model.weights.shape[1]
    unary = np.array(nodes.features, float) @ model.weights
    joint = np.zeros((k,) * n)
    axis = lambda x, *at: x.reshape([k if i in at else 1 for i in range(n)])
    for i in range(n):
        joint = joint + axis(unary[i], i)
    for pairs, potential in ((nodes.chain, model.chain), (nodes.skip, np.eye(k) * model.skip)):
        for i, j in pairs:
            joint = joint + axis(potential, i, j)
    p = np.exp(joint - joint.max())
    return np.array([p.sum(tuple(j for j in range(n) if j != i)) for i in range(n)]) / p.sum()


def test_message_passing_with_skip_edges():
    """Exact where skip edges close no loop; near the exact marginals, and of the same labels, where they do."""
    far = " word" * 12
    tree = pii.candidates(f"9f8e7d6c5b4a39281706{far} 9F8E7D6C5B4A39281706{far} 9f8e7d6c5b4a39281706", [], pii.Settings())
    assert not tree.chain and tree.skip == [(0, 1), (1, 2)]
    np.testing.assert_allclose(pii.infer(MODEL, [tree], 60), exact(MODEL, tree), atol=1e-6)
    for text in ("a1b2 c3 a1b2 d4 c3", "x7 x7 x7 x7", 'key="9f8e7d6c5b4a39281706" 5 9f8e7d6c5b4a39281706 5 5'):
        loop = pii.candidates(text, [], pii.Settings())
        got, want = pii.infer(MODEL, [loop], 60), exact(MODEL, loop)
        assert len(loop.chain) + len(loop.skip) >= len(loop.spans)
        assert (got.argmax(1) == want.argmax(1)).all() and np.abs(got - want).max() < 0.15


def test_training_takes_its_bound_and_no_more():
    long, texts = " ".join(f"n{i}" for i in range(5000)), corpus()
    seen = []
    pii.train((seen.append(t) or t for t in [long, *texts]), pii.Settings(tokens=700, share=300))
    assert 50 < len(seen) < 200  # the long one did not use it up, and nothing was read beyond the bound
    assert np.isfinite(pii.train([long], pii.Settings(tokens=10)).weights).all()


def test_order_of_the_sample_is_that_of_the_hash(spark, documents, monkeypatch):
    docs = documents([(i, f"number {i}") for i in range(40)])
    order = [r["doc_id"] for r in docs.orderBy(pii.F.xxhash64("doc_id")).collect()]
    seen = []
    monkeypatch.setattr(pii, "train", lambda texts, settings: seen.extend(texts))
    pii.fit(docs, pii.Settings(sample=25))
    assert seen == [f"number {i}" for i in order[:25]]


def test_added_spans_recall_and_precision(spark):
    """Held out: planted secrets that are assigned to names, and repeat without one, are found; plain numbers are not."""
    rng = random.Random(9)
    texts, planted = [], []
    for i in range(200):
        secret = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: rng.choice((16, 62))]) for _ in range(rng.choice((24, 32, 40))))
        noise = lambda: " ".join(rng.choice(["words", "here", f"{rng.randrange(3000)}", f"v{rng.randrange(9)}.{rng.randrange(9)}", "item-7", "3rd", "B2B", "1,000"]) for _ in range(30))
        texts.append(f'{noise()} {rng.choice(["token", "api_key", "password"])} = "{secret}" {noise()} {secret} {noise()}')
        planted.append(secret)
    model, texts, planted = pii.train(texts[:100]), texts[100:], planted[100:]
    _, every = pii.find_batch(model, texts)
    found = [[t[a:b] for a, k, b in spans if k == 4] for t, spans in zip(texts, every)]
    hits, right = sum(len(x) for x in found), sum(x.count(s) for x, s in zip(found, planted))
    assert right >= 0.9 * 2 * len(texts) and right >= 0.98 * hits


def test_slices_do_not_change_results(monkeypatch):
    texts = corpus()[:40]
    whole = pii.find_batch(MODEL, texts)
    monkeypatch.setattr(pii, "TOGETHER", 50)
    assert pii.find_batch(MODEL, texts) == whole
