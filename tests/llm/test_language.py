"""Language mixtures: accuracy, mixtures, and texts without anything to say."""

from conftest import SMALL
from pyspark.sql import functions as F
from tablesteward.llm import language
from tablesteward.llm.batches import table


def test_held_out_accuracy(spark):
    docs = table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents")
    rows = language.op9_language_id(spark, SMALL.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97 and rows.where("score < 0 or score > 1").count() == 0


def test_defined_results(spark):
    names, model = language.learned(table(spark, SMALL, "documents"))
    kind = "doc_id long, text string, lang_pred int"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 !?", 0), (4, "the and of", 0), (None, "der und", 0)], kind)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs.drop("lang_pred"), names, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en" and got[None][0] == "de"
    nothing = language.learned(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert nothing[0] == []
    assert language.predicted(docs.select("doc_id", "text"), *nothing).where("lang_pred = 'und'").count() == 5
    assert language.predicted(docs.select("doc_id", "text").where("false"), names, model).count() == 0


def test_mixture_of_two(spark):
    docs = table(spark, SMALL, "documents")
    names, model = language.learned(docs)
    english, german = (docs.where(f"lang = '{lang}' and n_chars > 2000").first()["text"].encode()[:2000] for lang in ("en", "de"))
    at, share = language.inferred(english + b" " + german[:800], model)
    assert names[at] == "en" and 0.55 < share < 0.9
