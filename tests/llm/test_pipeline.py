import public_tokenizers
import tiktoken

import corpus_pipeline as P
from geofeat.llm import bpe, secrets
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_similar import brute as similarity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {"documents": docs.collect()}
    frame = docs
    for name, stage in P.STAGES:
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), stage(spark, frame, SF).schema)
        rows[name] = frame.collect()
        if name != "tokens":
            assert frame.columns == columns
    ids = {k: {r.doc_id for r in v} for k, v in rows.items()}

    assert ids["toxicity"] <= ids["documents"] and len(ids["toxicity"]) > 0.8 * len(ids["documents"])
    alike = similarity([(r.doc_id, r.text) for r in rows["toxicity"]])
    assert ids["near_duplicates"] == {c for _, _, c in alike}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids["decontamination"] == {r.doc_id for r in rows["near_duplicates"] if not contamination(r.text, items)[1]}
    assert ids["secrets"] == ids["decontamination"] == ids["tokens"]
    novelty = secrets.Novelty()
    texts = {r.doc_id: r.text for r in rows["secrets"]}
    for r in rows["decontamination"]:
        found = secrets.scan(r.text or "", novelty)
        assert (texts[r.doc_id] == r.text) == (not found)
        assert not any((r.text or "")[a:b] in (texts[r.doc_id] or "") for a, _, b in found)
    own = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for r in rows["tokens"]:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_run_is_the_stages_in_a_row(spark):
    out = P.run(spark, SF)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert 0 < out.count() <= 200


def test_cases_of_every_stage(spark):
    long = " ".join(f"word{i}" for i in range(50_000))
    rows = [(1, None, 1.0, "a", "x"), (2, "", 1.0, "a", "x"), (3, long, 1.0, "a", "x"), (3, long, 1.0, "a", "x"), (4, long, 1.0, "b", "x"), (None, long, 1.0, "b", "y"), (5, "api_key = abcdef123456", 2.0, "b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double, lang string, source string").withColumnRenamed("toxicity", "Toxicity")
    kept = {"toxicity": [None, 1, 2, 3, 3, 4, 5], "near_duplicates": [None, 1, 2, 3, 3, 5], "decontamination": [None, 1, 2, 3, 3, 5], "secrets": [None, 1, 2, 3, 3, 5], "tokens": [None, 1, 2, 3, 3, 5]}
    frame = docs
    for name, stage in P.STAGES:
        got = stage(spark, frame, SF)
        if name != "tokens":
            assert got.columns == docs.columns
        assert stage(spark, frame.where("false"), SF).count() == 0
        out = got.collect()
        assert sorted((r.doc_id for r in out), key=lambda i: i or 0) == kept[name], name
        frame = spark.createDataFrame(out, got.schema)
    assert {r.doc_id: r.n_tokens for r in out}[1] == 0
