import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from geofeat.llm import decontaminate as D


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        m = min(len(w), 10)
        if m:
            windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
            for k in range(len(own) - m + 1):
                if tuple(own[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found.add(i)
    return len(own), hit, sorted(map(str, found))


@pytest.mark.parametrize("short", [False, True])
def test_equals_brute_force(spark, short):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "É", "é", "x1", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(10, 30))) for i in range(6)] + ([(9, "the of"), (10, "beta"), (11, "É x1 the beta of"), (12, None), (13, " ,;")] if short else [])
    docs = [(i, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + " " + text(rng.randint(0, 9))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, text(4)), (None, items[0][1]), (103, items[1][1]), (103, items[1][1]), (104, items[2][1]), (104, "other words")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item", F.lit("z"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, sorted(r.places), list(r.items)) for r in D.hits(a, b).collect())
    expected = sorted((str(i), n, sorted(hit), found) for i, t in docs for n, hit, found in [brute(t, items)])
    assert got == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in D.hits(docs, items).collect()] == [(1, 3, [], [])]
    assert D.hits(docs.where("false"), items).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in D.op6_decontaminate(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        n, hit, found = brute(d.text, items)
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
