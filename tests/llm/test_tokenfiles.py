import random

import numpy as np
import pytest
from hyperdelta.llm import tokenfiles as T
from hyperdelta.llm.tokens import default_vocabulary, encode_ordinary


@pytest.mark.parametrize("block", [1, 2, 7, 64, 100_000])
def test_flat_files(spark, tmp_path, block):
    rng, want = random.Random(block), []
    for f, width in ((0, 2), (1, 2), (2, 2)):
        ids = []
        for k in range(25):
            n = rng.choice([0, 0, 1, 5, 200])
            ids += [rng.randrange(50_000) for _ in range(n)] + [50256]
            want.append((f, k, n))
        if f == 1:  # no separator at its end
            ids += [9] * 150
            want.append((f, 25, 150))
        np.array(ids, f"<u{width}").tofile(tmp_path / f"f{f}.bin")
    (tmp_path / "f9.bin").write_bytes(b"")
    layout = T.Layout(block=block)
    rows = T.count(T.read_blocks(spark, str(tmp_path), layout), layout).collect()
    assert sorted((int(r["file"][-5]), r["ordinal"], r["n_tokens"]) for r in rows) == want


def test_four_byte_ids(spark):
    layout = T.Layout(separator=0, width=4, block=4)
    data = np.array([5, 0, 100_000, 7, 0], "<u4").tobytes()
    blocks = spark.createDataFrame([("f", 0, data[:16]), ("f", 1, data[16:])], "file string, block long, data binary")
    assert sorted((r["ordinal"], r["n_tokens"]) for r in T.count(blocks, layout).collect()) == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="inside a token"):
        T.scan(spark.createDataFrame([("f", 0, b"\x00\x01")], "file string, block long, data binary"), layout).collect()


@pytest.mark.parametrize("block", [3, 1000, 1 << 18])
def test_documents(edge, documents, block):
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in T.document_counts(edge, T.Layout(block=block)).collect())
    want = sorted((str(r["doc_id"]), len(encode_ordinary(default_vocabulary(), (r["text"] or "").encode()))) for r in edge.collect())
    assert got == want
    assert T.document_counts(documents([]), T.Layout(block=block)).count() == 0


@pytest.mark.parametrize("span", [1, 2, 5])
def test_the_scan_has_two_levels(spark, monkeypatch, span):
    """Documents over many blocks and many spans of them, and spans without a separator."""
    monkeypatch.setattr(T, "SPAN", span)
    rng, layout, rows, want = random.Random(span), T.Layout(separator=0, width=4, block=3), [], []
    for f in ("a", "b"):
        sizes = [rng.choice([0, 1, 2, 9, 40]) for _ in range(30)]
        ids = np.array([x for n in sizes for x in [7] * n + [0]] + [7] * 25, "<u4")
        rows += [(f, k, ids[3 * k : 3 * k + 3].tobytes()) for k in range(-(-len(ids) // 3))]
        want += [(f, k, n) for k, n in enumerate([*sizes, 25])]
    rng.shuffle(rows)
    got = T.count(spark.createDataFrame(rows, "file string, block long, data binary"), layout)
    assert sorted(map(tuple, got.collect())) == want


def test_files_of_the_query_are_flat(spark, documents):
    """Ids and separators side by side, nothing else; a file is read in many blocks by more than one task."""
    docs = documents([(i, f"text number {i} " * 50) for i in range(40)])
    files, names = T.write_files(docs.repartition(1), T.Layout())
    ((file, size),) = files.collect()
    ids = np.fromfile(file.removeprefix("file:"), "<u2")
    order = [r["doc_id"] for r in names.orderBy("ordinal").collect()]
    want = [x for i in order for x in [*encode_ordinary(default_vocabulary(), f"text number {i} ".encode() * 50), 50256]]
    assert ids.tolist() == want and size == 2 * len(want) and sorted(order) == list(range(40))
    blocks = T.blocks_of(files, T.Layout(block=100))
    assert blocks.rdd.getNumPartitions() > 2 and b"".join(bytes(r["data"]) for r in blocks.orderBy("block").collect()) == ids.tobytes()
