import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geofeat.llm import bpe

DATA = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OWN = bpe.Codec(DATA, public_tokenizers.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_encode_equals_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = OWN.encode(text).tolist()
    assert ids == LIB.encode_ordinary(text)
    assert OWN.decode(ids).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeinst", min_size=1, max_size=400))
def test_long_pretokens(text):
    assert OWN.merge(text.encode()) == LIB.encode_ordinary(text)


def test_very_long_pretoken():
    text = "tionthe" * 20_000 + "é" * 5_000
    assert OWN.encode(text).tolist() == LIB.encode_ordinary(text)


def test_frame_cases(spark):
    rows = [(1, "Hello  world\n", "x"), (2, None, "y"), (3, "", "z"), (4, "Hello  world\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, DATA, public_tokenizers.PATTERN), DATA)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert got[1].ids == LIB.encode_ordinary("Hello  world\n") == got[4].ids
    assert bytes(got[1].decoded) == b"Hello  world\n"
    assert got[2].ids is None and got[2].decoded is None
    assert got[3].ids == [] and bytes(got[3].decoded) == b""
    both = bpe.encode(df, DATA, public_tokenizers.PATTERN, decoded_col="x")
    assert both.columns == ["doc_id", "text", "ids", "x"]
    assert {r.doc_id: r.x and bytes(r.x) for r in both.collect()} == {r.doc_id: r.decoded and bytes(r.decoded) for r in out.collect()}
    assert bpe.encode(df.where("false"), DATA, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("keep,left", [(True, 2), (False, 0)])
def test_pretokens_outlive_a_task_only_where_asked(spark, monkeypatch, keep, left):
    df, tasks = spark.createDataFrame([], "doc_id long, text string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append(run))
    bpe.encode(df, DATA, public_tokenizers.PATTERN, keep=keep)
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" thhathha erbletion"]})
    assert [b.num_rows for b in tasks[0](iter([rows]))] == [1]
    own = bpe.codec(DATA, public_tokenizers.PATTERN)
    assert len(own.pieces) == left
    own.forget()


def test_memory_of_pretokens_is_bounded():
    own = bpe.Codec(DATA, public_tokenizers.PATTERN)
    own.remember(3)
    for k in range(20):
        text = f" word{k}x{k}"
        assert own.encode(text).tolist() == LIB.encode_ordinary(text)
        assert len(own.pieces) <= 3 and len(own.pieces.old) <= 3


def test_unknown_id(spark):
    with pytest.raises(ValueError):
        OWN.decode([60_000])


def test_query_against_library(spark):
    got = {r.doc_id: r for r in bpe.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = LIB.encode_ordinary(d.t)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.t.encode()).hexdigest()
