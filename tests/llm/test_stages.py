"""Every stage of the pipeline on tables that are odd or empty."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, Row int, runs string, toxicity double, t int, h int, n int, size int, node string, id int, words string"


def words(rng, n, size=4_000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def rows():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", words(rng, 90), words(rng, 4_000), "x" * 3_000, "漢字 かな " * 30, words(rng, 40)]
    out = [(k, t) for k, t in enumerate(texts)] + [(4, words(rng, 60)), (None, words(rng, 50)), (None, None), (8, texts[8]), (8, texts[8]), (12, texts[4])]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, "k", 1, "r", 0.5, 2, 3, 4, 5, "n", 6, "w") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    at = str(tmp_path_factory.mktemp("tables"))
    known = [(1_000 + k, words(rng, 60) + (" dreadful scoundrel" * 3 if k % 4 == 0 else "")) for k in range(120)]
    spark.createDataFrame(known, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in known], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, words(rng, 30)), (2, None), (None, "one two")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_rows_and_all_columns(spark, folder, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "docs"))
    for docs in (spark.createDataFrame(rows(), SCHEMA), spark.read.parquet(str(tmp_path / "docs"))):
        out = stage(spark, docs, folder)
        got = out.collect()
        if name == "mixing":
            assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == len(rows()) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
            continue
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        if name == "minhash near-dedup":  # of the repeated text of id 8 and the copy of id 4's first text one row each goes on
            assert len(got) == len(rows()) - 3 and sum(r["doc_id"] == 4 for r in got) == 2 and sum(r["doc_id"] == 8 for r in got) == 1 and all(r["doc_id"] != 12 for r in got)
        else:
            assert len(got) == len(rows()) and sum(r["text"] is None for r in got) == 2
        assert {(r["key"], r["Row"], r["runs"], r["toxicity"], r["node"], r["words"]) for r in got} == {("k", 1, "r", 0.5, "n", "w")}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, folder, name, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder).count() == 0


def test_stages_without_labels_or_items(spark, folder, tmp_path):
    at = str(tmp_path)
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{at}/{table}.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, at).count() == len(rows()) and stages["benchmark decontamination"](spark, docs, at).count() == len(rows())
