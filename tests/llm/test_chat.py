import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from geofeat.llm import bpe, chat

DATA = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ALIGNER = chat.Aligner(bpe.Codec(DATA, public_tokenizers.PATTERN))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ALIGNER.own.ranks, special_tokens={})
SPICY = st.text(alphabet="\\#</turn>: \n aé😀u", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", ""]), SPICY), max_size=5))
def test_round_trip_and_mask(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    ids, starts, ends = ALIGNER.encode(formatted)
    assert ids.tolist() == LIBRARY.encode_ordinary(formatted)
    assert ALIGNER.own.decode(ids.tolist()).decode() == formatted
    trained = [s for s, t in zip(spans, turns) if t[0] == "assistant"]
    loss = chat.loss_mask(trained, starts, ends)
    assert loss.tolist() == [any(s < b and a < e for a, b in trained if a < b) for s, e in zip(starts, ends)]
    _, masked = chat.read_back(formatted, starts, ends, loss, trained)
    assert masked == "".join(t for r, t in turns if r == "assistant")


def test_frame_cases(spark):
    rows = [(1, 1, None, "b", 0), (1, 0, "assistant", None, 0), (1, 0, "assistant", None, 0), (None, None, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.format_chats(df, DATA, public_tokenizers.PATTERN).collect()}
    assert chat.parse(got[1].formatted) == [("assistant", ""), ("assistant", ""), ("", "b")]
    assert not any(got[1].loss)
    assert chat.parse(got[None].formatted) == [("user", "x")]
    assert chat.format_chats(df.where("false"), DATA, public_tokenizers.PATTERN).count() == 0


def test_query_against_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    turns = defaultdict(list)
    for r in rows:
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in chat.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == turns.keys()
    for key, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[key].n_turns == len(own)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_very_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"é{i} " * 3_000) for i in range(40)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), DATA, public_tokenizers.PATTERN).collect()[0]
    assert chat.parse(got.formatted) == [(r, t) for *_, r, t in rows]
    assert sum(got.trained[1::2]) - sum(got.trained[::2]) == sum(len(t) for *_, r, t in rows if r == "assistant")
