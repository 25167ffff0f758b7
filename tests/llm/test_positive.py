"""The quality classifier: held-out labels, the prior, and a risk checked by differences."""

import random
import zlib

import numpy as np
import pytest

from geofeat.llm import positive as pu

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):  # ties share their mean rank
        ranks[s == v] = ranks[s == v].mean()
    k = y.sum()
    return (ranks[y == 1].sum() - k * (k + 1) / 2) / (k * (len(y) - k))


@pytest.fixture(scope="module")
def result(spark):
    rows = pu.op13_quality_classifier(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return rows, labels


def test_every_document_once_and_the_hold_out(spark, result):
    rows, _ = result
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_labels(result):
    """Better than the majority: the order (AUC), the share of bad texts found, and that of good ones kept."""
    rows, labels = result
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    y, s, p = (np.array(x) for x in zip(*held))
    assert len(y) > 60 and (y == 0).sum() >= 5
    assert auc(y, s) > 0.97
    assert p[y == 1].mean() > 0.97 and (1 - p[y == 0]).mean() > 0.8


def test_labels_of_bad_and_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    rows = pu.written(pu.featured(docs))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = pu.fit(rows, labels.where("quality = 1"))
    assert np.array_equal(plain.network.w, pu.fit(rows, labels).network.w)


def test_the_prior_follows_the_share_of_good_texts(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "epsilon."]) for _ in range(rng.randrange(20, 90)))
    bad = lambda: " ".join(rng.choice(["A##", "B$$$", "C%%", "D!!"]) for _ in range(rng.randrange(20, 90)))
    for share in (0.3, 0.7):
        texts = [(k, good() if k < share * 2_000 else bad()) for k in range(2_000)]
        rows = pu.written(pu.featured(spark.createDataFrame(texts, "doc_id long, text string")))
        model = pu.fit(rows, spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int"))
        assert abs(model.prior - share) < 0.12
        s = {r.doc_id: r.score for r in pu.scored(rows, model).collect()}
        assert np.mean([s[k] > 0.5 for k in range(int(share * 2_000))]) > 0.97 and np.mean([s[k] < 0.5 for k in range(int(share * 2_000), 2_000)]) > 0.97


def test_prior_from_counts():
    every, good = np.array([100, 100, 100, 300]), np.array([50, 50, 50, 0])
    assert 0.4 < pu.class_prior(every, good) < 0.5
    assert 0.495 < pu.class_prior(every * 10_000, good * 10_000) < 0.5


def test_figures_of_odd_texts():
    assert not pu.figures(None).any() and not pu.figures(b"").any() and not pu.figures(b" \n").any()
    x = pu.figures("Ä!! B## b b b\nl\nl".encode())
    assert np.isfinite(x).all() and len(x) == pu.FEATURES
    long = pu.figures(b"word and word " * 300_000)
    assert np.isfinite(long).all() and long[0] > np.log(800_000)


def test_nothing_to_learn_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "Good words here.", 5.0, "x"), (1, "Good words here.", 6.0, "y"), (None, None, 7.0, "z"), (2, "", 8.0, "w")], "doc_id long, Text string, Score double, other string")
    rows = pu.featured(df)
    none = pu.scored(rows, pu.fit(rows, spark.createDataFrame([(2, 0), (None, 1)], "doc_id long, quality int"))).collect()
    assert {r.score for r in none} == {0.5} and {r.other for r in none} == set("wxyz")
    one = pu.scored(rows, pu.fit(rows, spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int"))).collect()
    assert len({r.score for r in one if r.other in "xy"}) == 1 and len({r.score for r in one if r.other in "zw"}) == 1
    assert pu.scored(rows.limit(0), pu.QualityModel()).count() == 0
    assert pu.fit(rows.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).network is None
