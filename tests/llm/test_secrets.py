import hashlib
import random
import re

import pytest

from geofeat.llm import secrets as S

NOVELTY = S.Novelty()


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    parts = ["token", "API_KEY", "Secret", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "x", "-", "\n", "ſecret"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        raw = text.encode()
        assert S.base_spans(text, raw, raw.lower()) == brute(text)


@pytest.mark.parametrize("key", ["q7Hx92LmPz41VbTnYw83RkEd", "Zk3-9fQ_w81LrTb5NcXy0GhU2vPq"])
def test_novel_run_found(key):
    text = f"headers: Authorization: Bearer {key} and then the rest of the text"
    assert [text[a:b] for a, k, b in S.scan(text, NOVELTY) if k == 3] == [key]


@pytest.mark.parametrize("text", ["Authorization: Bearer abcdefghijklmnopqrstuvwxyz0123456789", "session_timeout_default_config_settings1", "plain q7Hx92LmPz41VbTnYw83RkEd text", "auth " + "a1" * 20])
def test_dull_run_left_alone(text):
    assert not [x for x in S.scan(text, NOVELTY) if x[1] == 3]


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, 'token = "abcdef1"', "c"), (3, 'token = "abcdef1"', "c")], "doc_id long, text string, secrets string")
    got = S.find_secrets(df).collect()
    assert [r.secrets for r in sorted(got, key=lambda r: r.doc_id)] == [None, [], [("assign", 0, 16)], [("assign", 0, 16)]]
    assert S.find_secrets(df.where("false")).count() == 0
    assert {r.text for r in S.redact(df).collect()} == {None, "", '[secret]"'}


def test_query_against_patterns(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in S.op10_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        told = [f"{S.KINDS[k]}:{a}:{b}" for a, k, b in brute(text)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(got[i].spans.split(",")) | {""}
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in told) for k in S.KINDS[:3])
