"""Toxicity and language: held-out accuracy and odd rows."""

import pytest
from pyspark.sql import functions as F

from wildgrid.llm import language, toxicity
from wildgrid.llm.common import held_out, table

FOLDER = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = toxicity.learn(docs, labels, ~held_out())
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(held_out())
    right = {(r["toxic"], r["p"]): r["count"] for r in
             scored.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).count().collect()}
    assert right.get((1, True), 0) >= 0.9 * sum(n for (t, _), n in right.items() if t == 1)
    assert right.get((0, False), 0) >= 0.97 * sum(n for (t, _), n in right.items() if t == 0)


def test_toxicity_features():
    weights = toxicity._Weights({b"=idiot": 0.99})
    names = toxicity.FEATURES
    at = lambda text: dict(zip(names, toxicity.features_of(text, weights)))
    plain, rude, hidden = at(b"you are so kind"), at(b"you are an idiot"), at(b"such an 1d10t here")
    assert plain["strong_density"] == 0 and rude["strong_density"] == 25 and rude["near_second"] == 1
    assert hidden["hidden_density"] > 0 and at(b"SHOUT now")["shouted"] == 0.5
    assert toxicity.features_of(b"", weights) == [0.0] * len(names)
    assert len(toxicity.features_of(b"!!!", weights)) == len(names)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (10, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    one_class = toxicity.learn(odd, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(odd, one_class).collect()} == {0.0}
    few = toxicity.learn(odd, labels, F.lit(True))
    rows = toxicity.score(odd, few).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.learn(empty, labels, F.lit(True))).count() == 0
    many = spark.createDataFrame([(i, "you idiot " * 3 if i % 3 == 0 else "a fine day " * 3, int(i % 3 == 0))
                                  for i in range(90)], "doc_id long, text string, toxic int")
    trained = toxicity.fit(many)
    assert trained[1] is not None
    assert toxicity.score(odd, trained).count() == odd.count() and toxicity.score(empty, trained).count() == 0
    found = {r["doc_id"]: r["score"] for r in toxicity.score(many, trained).collect()}
    assert all((found[i] > 0.5) == (i % 3 == 0) for i in found)


def test_language_held_out(spark):
    docs = table(spark, FOLDER, "documents")
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs.where(held_out()), model, keep=("doc_id", "lang"))
    right, rejected, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")),
                                   F.avg(F.col("rejected").cast("int")), F.count("*")).first()
    assert n > 2000 and right > 0.97 and rejected < 0.002


@pytest.mark.parametrize("text, letter", [("", False), ("12 !?   —", False), ("a", True), ("日", True), ("é", True)])
def test_letters(text, letter):
    assert language.has_letter(text.encode()) == letter


def test_language_of_odd_rows(spark, odd, empty):
    words = {"en": "the house stands near a river and the old tree",
             "de": "das Haus steht nahe bei einem Fluss und dem alten Baum"}
    rows = [(i, lang, f"{text} {i}") for i in range(30) for lang, text in words.items()]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == found[8]["lang_pred"] == "und"
    assert found[4]["score"] == 0 and found[4]["rejected"] and found[1]["lang_pred"] == "en"
    assert language.identify(odd, model).count() == odd.count() and language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}
    assert language.fit(odd)[1]
    far = spark.createDataFrame([(1, "zxqj wvkq " * 40)], "doc_id long, text string")
    assert language.identify(far, model).first()["rejected"]
