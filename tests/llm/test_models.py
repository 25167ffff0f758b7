import zlib

import numpy as np
from pyspark.sql import functions as F

from geofeat.llm import langid, toxicity
from geofeat.llm.boosting import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.01"


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_trees_learn_a_conjunction():
    x = np.random.default_rng(0).random((2_000, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    model = BoostedTrees().fit(x, y)
    assert ((model.margin(x) > 0) == y).mean() > 0.97
    assert np.allclose(BoostedTrees().fit(x, np.zeros(2_000)).margin(x), np.log(0.5 / 2_000.5))


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(1)
    s = rng.random(500)
    y = (rng.random(500) < s).astype(float)
    fit = Isotonic().fit(s, y)
    p = fit(np.sort(s))
    assert (np.diff(p) >= -1e-12).all() and abs(fit(s).mean() - y.mean()) < 1e-9


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = langid.op9_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == is_held_out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (3, "123 !", 2.0), (4, "the end of the line", 2.0), (4, "the end of the line", 2.0)], "doc_id long, text string, score double")
    model = langid.fit([("the end of the day and that is it", "en"), ("der Anfang und das Ende von dem Tag", "de")] * 40)
    got = sorted(langid.predict(df, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in got] == ["und"] * 3 + ["en"] * 2
    assert [r.score for r in got[:3]] == [0.0] * 3
    assert langid.predict(df.where("false"), model).count() == 0
    assert langid.fit([]).predict("words")[0] == "und"


def test_toxicity_held_out(spark):  # 94 rows, of which few are toxic
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.op5_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    assert right > 0.85
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "you are an idiot", "z"), (3, "you are an id10t", "z")], "doc_id long, text string, score string")
    model = toxicity.ToxicityModel(frozenset())
    got = sorted(toxicity.scored(df, model).collect(), key=lambda r: (r.doc_id, r.score))
    assert [r.score for r in got] == [0.05, 0.05, 0.9, 0.9]
    none = toxicity.fit(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.trees is None
    assert toxicity.scored(df.where(F.lit(False)), model).count() == 0


def test_language_sample_is_stratified_and_distinct(spark):
    rows = [("the same text", "en")] * 300 + [(f"text number {i}", "en") for i in range(300)] + [(f"Wort {i}", "de") for i in range(5)] + [("the same text", "fr"), (None, "en"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = langid.sample(df, 50)
    assert len(set(got)) == len(got)
    assert {lang: sum(x == lang for _, x in got) for lang in ("en", "de", "fr")} == {"en": 50, "de": 5, "fr": 1}
    assert got == langid.sample(df.repartition(7), 50) == langid.sample(df.orderBy(F.desc("text")).coalesce(1), 50)
    assert len(langid.sample(df.where("false"))) == 0
