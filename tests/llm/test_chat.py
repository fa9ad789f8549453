import hashlib
import random

import pytest
from hyperdelta.llm import chat


def expected(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(7)
    pieces = ["</turn>\n", "</turn", "<turn user>\n", "\\", "\\\\", "<", ">", "<image:0>", "\n", "é😀", "ok", "### Assistant:", "<audio:"]
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", "as>is\\tant", "", None, "system"]), rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))])) for _ in range(rng.randrange(1, 7))]
        want[conv] = expected(turns)
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.formatted(chat.text_parts(df))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == want
    lengths = {r["conv_id"]: r["n"] for r in formatted.groupBy("conv_id").agg({"output": "max"}).selectExpr("conv_id", "1 AS n").collect()}
    assert len(lengths) == 60


def test_escapes_are_reversible():
    for text in ("\\", "\\\\</turn>", "<turn", "</turn>\n", "\\<image:1>", ""):
        assert chat.unescape(chat.escape(text)) == text and "</turn>" not in chat.escape(text).replace("\\</turn>", "")


def test_parts(spark):
    parts = [
        {"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 1000, "height": 500}, {"type": "text", "text": " <image:0> "},
        {"type": "audio", "ref": "b.wav", "seconds": 2.1}, {"type": "document", "ref": "c.pdf", "pages": 3},
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = chat.formatted(df).orderBy("turn").collect()
    assert one["output"] == "<turn assistant>\nsee <image:0> \\<image:0> <audio:1><document:2></turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 53), ("document", "c.pdf", 3072)]
    assert one["expanded_tokens"] == 3637 and one["output"][one["loss_start"] : one["loss_end"]].startswith("see ")
    assert two["output"] == "<turn user>\n</turn>\n" and two["loss_start"] == two["loss_end"]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}], frozenset())


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, output string, loss_start string"
    df = spark.createDataFrame([(None, 0, "user", "a", "x", "y"), (1, None, "assistant", "first", "x", "y"), (1, 0, "assistant", "t", "x", "y"), (1, 0, "assistant", "t", "x", "y"), (2, 0, "user", "l" * 300_000, "x", "y")], schema)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.formatted(chat.text_parts(df))).collect()}
    assert got == {None: expected([("user", "a")]), 1: expected([("assistant", "first"), ("assistant", "t"), ("assistant", "t")]), 2: expected([("user", "l" * 300_000)])}
    assert chat.digests(chat.formatted(chat.text_parts(df.limit(0)))).count() == 0


def test_one_conversation_with_most_turns(spark):
    """Longer than a batch: streamed turn by turn."""
    turns = [("assistant" if i % 2 else "user", f"text {i}") for i in range(7000)]
    df = spark.createDataFrame([(9, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert tuple(chat.digests(chat.formatted(chat.text_parts(df))).first())[1:5] == expected(turns)


def test_bad_parts_have_a_defined_result(spark):
    """Null parts are empty, sizes that are no numbers are 0, unknown types are listed and nothing stops."""
    nan = float("nan")
    parts = [None, {"type": "text", "text": None}, {"type": "audio", "ref": "a", "seconds": nan}, {"type": "audio", "seconds": -3.0}, {"type": "audio", "seconds": float("inf")},
             {"type": "document", "pages": -2}, {"type": "image", "width": -5, "height": None}, {"type": "video", "ref": "v"}, {"type": None}, {"type": "text", "text": "end"}]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, [None])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = chat.formatted(df).orderBy("turn").collect()
    assert one["output"] == "<turn assistant>\n<audio:0><audio:1><audio:2><document:3><image:4>end</turn>\n"
    assert [a["tokens"] for a in one["attachments"]] == [0, 0, 0, 0, 256] and one["expanded_tokens"] == 256
    assert one["refused"] == ["video", "None"] and two["refused"] == [] and two["output"] == "<turn >\n</turn>\n"
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "out"}], frozenset())
