"""Real clashes of column names, and texts of more than a million characters, in the operators that read texts."""

import pytest
from tablesteward.llm import language, maxent, mixing, sharding, simhash

LONG = "alpha beta gamma delta " * 50_000


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, lang string, source string, n_tokens long, row_id long, lang_pred string, score double, shard int, slot int, __id long, __hash long"
    rows = [(1, LONG, "en"), (2, "eins zwei drei", "de"), (3, None, None), (3, "", "en"), (None, "alpha beta", "en"), (5, "alpha beta", "en"), (5, "alpha beta", "en")]
    return spark.createDataFrame([(*row, "s", 9, 9, "mine", 0.5, 7, 7, 70, 71) for row in rows], kind)


def test_language_model(docs):
    model = maxent.learn(docs)
    got = maxent.scored(docs, model).collect()
    assert len(got) == 7 and {r.row_id for r in got} == {9} and {r["__id"] for r in got} == {70}
    assert max(r.n_tokens for r in got) == 200_001 and all(r.score != 0.5 for r in got)
    assert len(maxent.scored(docs.select("text"), model).collect()) == 7


def test_language(docs):
    names, model = language.learned(docs.select("text", "lang"))
    got = language.predicted(docs, names, model).collect()
    assert {r.lang_pred for r in got} <= {"en", "de", "und"} and {r.n_tokens for r in got} == {9}


def test_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=3)
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.count() == 7 and {r["__id"] for r in written.collect()} == {70}
    assert written.where("shard = 7").count() == 0


def test_mixing_and_simhash(docs):
    assert mixing.repeated_documents(docs).columns == docs.columns
    sizes = {r.size for r in mixing.mixed(docs).collect()}
    assert max(sizes) == 200_000
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("n_tokens = 9").count() == kept.count() < 7
