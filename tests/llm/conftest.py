import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long, rank string, part string, length string, component_id string, threshold string, mean string, file string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(pairs, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *["x", 1, "x", "x", "x", "x", "x", "x", "x"]) for i, t in pairs], CLASH)

    return make


@pytest.fixture(scope="session")
def edge(documents):
    """Nulls, empty and blank texts, repeated rows, a long text, and one with odd characters."""
    return documents([(None, "no id " * 30), (1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, "word " * 60_000), (7, "é漢😀\x00\x1f <|endoftext|> \\ x"), (8, "x" * 200_000)])
