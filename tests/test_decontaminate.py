"""The pipeline's benchmark stage judges every row by its own text, with an id or without."""

import corpus_pipeline
from geofeat.llm import decontaminate

PASSAGE = "one two three four five six seven eight nine ten eleven"


def test_rows_without_id_and_rows_that_share_one(spark, tmp_path):
    spark.createDataFrame([("a", PASSAGE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so " + PASSAGE), (None, "clean"), (None, None), (1, PASSAGE), (1, "clean too"), (2, "b c d")]
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, "clean"), (None, None), (1, "clean too"), (2, "b c d")]))


def test_every_window_of_an_item_is_met_wherever_it_stands(spark):
    words = [str(i) for i in range(40)]
    docs = [(i, "x y z " * (i % 7) + " ".join(words[i : i + 10]) + " w" * (i % 5)) for i in range(31)]
    items = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    found = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {r.doc_id: len(r.places) for r in found} == {i: 10 for i in range(31)}
