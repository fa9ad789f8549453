"""The stages one by one against brute force, each on what the one before it kept."""

import random
import re

import corpus_pipeline
from hyperdelta.llm import decontaminate, packing, pii, simhash


def prose(rng, n=80):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    docs = [(i, prose(rng), "en") for i in range(60)]
    items = [(i, prose(rng, 40)) for i in range(5)]
    docs += [(100, docs[3][1], "en"), (101, docs[4][1] + " more", "en")]  # copies
    docs += [(200, f"{prose(rng, 50)} {items[2][1]} {prose(rng, 30)}", "en")]  # a leak
    docs += [(300, f"{prose(rng, 40)} me@mail.example.org {prose(rng, 40)}", "en")]
    docs += [(400 + i, " ".join(f"###{rng.random()}" for _ in range(80)), "en") for i in range(5)]  # junk
    frame = spark.createDataFrame([(i, t, lang, "src", len(t)) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(400, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stage[name](spark, df, str(tmp_path))
    good = run("quality_classifier", frame).cache()
    assert good.columns == frame.columns and {r["doc_id"] for r in good.collect()} == {i for i, _, _ in docs if i < 400}
    once = run("simhash_near_dedup", good).cache()
    prints = {i: simhash.fingerprint(t.encode()) for i, t, _ in docs if i < 400}
    near = {i for i in prints if any(j < i and bin(prints[i] ^ prints[j]).count("1") <= 3 for j in prints)}
    assert 100 in near and {r["doc_id"] for r in once.collect()} == set(prints) - near
    clean = run("benchmark_decontamination", once).cache()
    grams = lambda t: decontaminate.shingles(decontaminate.words(t), 5)
    leaks = {i for i, t, _ in docs if any(len(grams(q) & grams(t)) > 0.8 * len(grams(q)) for _, q in items)}
    assert leaks == {200} and {r["doc_id"] for r in clean.collect()} == set(prints) - near - leaks
    masked = run("pii", clean).cache()
    texts = {i: t for i, t, _ in docs}
    for r in masked.collect():
        assert r["text"] == re.sub(r"\S+@\S+", "<EMAIL>", texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    placed = run("best_fit_packing", masked).collect()
    assert {r["doc_id"] for r in placed} == {r["doc_id"] for r in clean.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["ids_crc32"]) for r in placed)
    assert packing.Capacity().tokens == 1024 and pii.KINDS[:4] == pii.BASE


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_nulls(spark, tmp_path):
    rows = [(None, "a b c", None, None, None), (1, None, "en", None, None), (2, None, None, "s", 5), (3, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["1", "None"]
