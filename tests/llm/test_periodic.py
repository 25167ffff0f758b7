"""Runs against brute force, which extends every start under every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from geofeat.llm import periodic as pe

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of every run: for each period the stretches that agree with themselves so far on."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                best.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def expected(doc_id, text):
    words = SPACE.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted((s, q, length) for s, length, q in brute(words))
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + length for s, q, length in found)]
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if found else None
    shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
    return (doc_id, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for turn in range(1_500):
        words = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            part = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (part * 12)[: rng.randrange(8 * len(part))]
        got = [(r.start, r.length, r.period) for r in pe.runs(np.array(words, np.int64))]
        assert sorted(got) == brute(words), (turn, words)


def test_repeated_passages_which_agree_a_little_longer():
    """Passages that share 16 words and then some, so that the order behind those words counts."""
    rng = random.Random(9)
    for turn in range(400):
        head, words = [rng.randrange(50) for _ in range(17)], []
        for _ in range(rng.randrange(2, 9)):
            words += head[rng.randrange(2) :] + [rng.randrange(60, 63) for _ in range(rng.randrange(6))]
        words *= rng.randrange(1, 5)
        got = [(r.start, r.length, r.period) for r in pe.runs(np.array(words, np.int64))]
        assert sorted(got) == brute(words), (turn, words)


@pytest.mark.parametrize("n", [23, 24, 25, 20_000])
def test_one_word_over_and_over(n):
    assert pe.runs(np.zeros(n, np.int64)) == ([pe.Run(0, 1, n)] if n >= 24 else [])


def test_a_passage_in_very_many_places_stays_near_linear():
    """A passage of 40 words, each time behind another word: no run, and no work that grows with the square."""
    import time

    def seconds(times):
        ids = np.concatenate([np.r_[1_000 + k, np.arange(40)] for k in range(times)])
        began = time.process_time()
        assert pe.runs(ids) == []
        return time.process_time() - began

    seconds(200)
    assert seconds(8_000) < 12 * max(seconds(2_000), 0.2)


def test_very_long_text_and_shortest_period():
    ids = np.concatenate([np.arange(5_000), np.tile(np.arange(5_000, 5_007), 9_000), np.arange(5_000)])
    assert pe.runs(ids) == [pe.Run(5_000, 7, 63_000)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows, line = [], "a b c d e f g h i j"
    for k in range(400):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(300))]
        if k % 4 == 0:
            words[5:5] = ["x", "y"] * rng.randrange(40)
        rows.append((k, " ".join(words)))
    rows += [(1_000, None), (1_001, ""), (1_002, " \t\n"), (1_003, line), (1_004, "\n".join([line] * 3)), (1_005, "é ü " * 30), (1_006, "\x1c\x85 z\x0b" * 40), (1_003, line), (None, "w " * 30), (1_007, ("x y " * 12 + "| ") * 2)]
    rows += [(2_000 + k, "tie " * 24) for k in range(12)]  # some of them are made periodic
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pe.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60


def test_tables_without_rows_and_with_clashing_columns(spark):
    df = spark.createDataFrame([("w " * 30, "kept", 7)], "Text string, other string, Period int")
    row = pe.periodic_runs(df).first()
    assert (row.other, row.period, row.n_runs, bytes(row.collapsed)) == ("kept", 1, 1, b"w")
    assert pe.periodic_runs(df.limit(0)).count() == 0
