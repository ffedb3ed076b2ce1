"""The pipeline on a small table, stage by stage."""

import corpus_pipeline
from conftest import SMALL

KIND = "doc_id long, text string, lang string, source string, n_chars long, row_id long"


def test_stages(spark):
    text = " ".join(f"w{i}" for i in range(60))
    mail = text + " write to joe.doe@mail.example.com"
    rows = [(1, None, None, None, None, 1), (2, "", "a", "b", 0, 2), (3, "x y " * 30, "a", "b", 3, 3), (None, mail, "en", "b", 9, 4)]
    rows += [(5, text, "en", "s", 9, 5), (5, text, "en", "s", 9, 5), (6, text + " more", "en", "s", 9, 6)]
    docs = spark.createDataFrame(rows, KIND)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = docs
    assert sorted(r.doc_id or 0 for r in seen["quality_rules"].collect()) == [0, 5, 5, 6]
    assert seen["near_duplicates"].where("doc_id = 5").count() == 1
    assert "[email]" in seen["personal_data"].where("doc_id is null").first()["text"]
    assert all(seen[name].columns == KIND.replace(" long", "").replace(" string", "").split(", ") for name, _ in corpus_pipeline.STAGES[:-1])
    assert docs.where("n_tokens <> size(token_ids)").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
    assert docs.count() == 0
