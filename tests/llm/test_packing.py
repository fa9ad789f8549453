import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hyperdelta.llm import packing, tokens
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers():
    random.seed(1)
    pool = "abc  \n\t'sé漢😀\r!#12٣\x1c\x85ſ"
    for _ in range(500):
        text = "".join(random.choice([random.choice(pool), "<|endoftext|>", " the", chr(random.randrange(1, 0xD7FF))]) for _ in range(random.randrange(30)))
        assert tokens.encode(tokens.default_vocabulary(), text.encode()) == TOKENIZER.encode(text, add_special_tokens=False).ids


def check(rows, capacity):
    """Sequences are full from 0 on, without a gap, and within every capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= capacity.docs and sum(n * n for _, n in parts) <= capacity.cost
    return len(by)


def test_pieces_and_sequences(spark, documents):
    random.seed(2)
    rows = [(i, " ".join(random.choice(["alpha", "beta", "x"]) for _ in range(random.choice([0, 3, 40, 700, 2500])))) for i in range(80)]
    placed = packing.pack(documents(rows)).collect()
    used = check(placed, packing.Capacity())
    total = 0
    for i, text in rows:
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        mine = sorted((r for r in placed if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert -(-total // 1024) <= used <= 1.1 * total / 1024 + 1


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(64, 64, 4096), packing.Capacity(64, 3, 4096), packing.Capacity(64, 64, 1500), packing.Capacity(64, 2, 1600)])
def test_plan_holds_every_capacity(select, capacity):
    rng = random.Random(capacity.docs * 7 + capacity.cost)
    most = min(64, int(capacity.cost**0.5))
    histogram = {n: rng.randrange(200) for n in range(1, most + 1)}
    rows = []
    for length, rank, pieces, first, each, offset in packing.plan(histogram, capacity, select, (1, 0.5, 0.3)).tolist():
        rows += [{"sequence_id": first + k // each, "offset": offset + k % each * length, "length": length, "rank": rank + k} for k in range(pieces)]
    for n, count in histogram.items():
        assert sorted(r["rank"] for r in rows if r["length"] == n) == list(range(count))
    used = check(rows, capacity)
    floor = max(sum(n * c for n, c in histogram.items()) / capacity.tokens, sum(histogram.values()) / capacity.docs, sum(n * n * c for n, c in histogram.items()) / capacity.cost)
    assert used <= 1.35 * floor + 2


def test_edges(edge, documents):
    placed = packing.pack(edge).collect()
    check(placed, packing.Capacity())
    assert [(r["length"], r["start"]) for r in placed if r["doc_id"] == 1] == [(1, 0)]
    assert sum(r["doc_id"] == 4 for r in placed) == 2 and any(r["doc_id"] is None for r in placed)
    assert packing.pack(documents([])).count() == 0
    with pytest.raises(ValueError):
        packing.plan({65: 1}, packing.Capacity(64))


def test_token_sequences(documents):
    docs = documents([(1, "a b c"), (2, "d"), (3, "w " * 1500)])
    out = packing.sequences(docs, packing.pack(docs)).collect()
    ids = {i: [*TOKENIZER.encode(t, add_special_tokens=False).ids, 2] for i, t in ((1, "a b c"), (2, "d"), (3, "w " * 1500))}
    assert sum(len(r["ids"]) for r in out) == sum(map(len, ids.values()))
    for r in out:
        at = r["doc_ids"].index(2) if 2 in r["doc_ids"] else None
        if at is not None:
            assert r["ids"][r["offsets"][at] : r["offsets"][at] + len(ids[2])] == ids[2]


def test_long_white_space_has_the_ids_of_the_tokenizers_library():
    path = tokens.default_vocabulary()
    runs = (" " * 12_000, "\n" * 11_000, " \n\t　" * 4_000, " " * 10_500, "\x1c" * 10_001)
    texts = [f"{a}{r}{b}" for r in runs for a in ("", "a", "1!") for b in ("", "b", "!", "\x1c", "<|endoftext|>", "x" + r + "y")]
    for text in [*texts, " " * 2_000_000 + "end", "a" + "\n" * 1_200_000]:
        assert tokens.encode(path, text.encode()) == TOKENIZER.encode(text, add_special_tokens=False).ids
