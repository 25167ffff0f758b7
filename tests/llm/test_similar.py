import random

import pytest

from geofeat.llm import graph
from geofeat.llm import similar as S


def brute(rows):
    """doc rows (id, text) -> sorted (id, size, component)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posting = {}
    for k, s in enumerate(sets):
        for x in s:
            posting.setdefault(x, []).append(k)
    pairs = {(p[0], k) for p in posting.values() for k in p[1:]} | {(a, b) for p in posting.values() if len(p) <= 400 for i, a in enumerate(p) for b in p[i + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            parent[y] = x
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        if rng.random() < 0.5:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(copy) + 1)
                copy[k : k + rng.choice([0, 1, 8])] = [word() for _ in range(rng.choice([0, 1, 6]))]
            rows.append((len(rows), " ".join(copy).replace("a", "A", 1)))
    return rows


@pytest.mark.parametrize("seed,many", [(1, 64), (2, 3), (3, 1)])
def test_equals_brute_force(spark, seed, many, monkeypatch):
    monkeypatch.setattr(S, "MANY", many)
    if many == 1:
        monkeypatch.setattr(S, "BANDS", 0)  # no groups beforehand: the matrix alone has to find all
        monkeypatch.setattr(S, "bands", lambda marks: [])
        monkeypatch.setattr(S, "SMALL_GROUP", 0)
        monkeypatch.setattr(S, "BLOCK_SHINGLES", 150)
    rows = corpus(seed, 150)
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e"), (None, "one two"), (9, "x y z"), (9, "one two")]
    df = spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, n int, grp string")
    got = sorted(map(tuple, S.similar_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 2, 7), (8, 2, 8), (None, 1, None), (9, 1, 4), (9, 1, 4)], key=str)
    assert S.similar_components(df.where("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101), (101, 101)], "a long, b long")
    got = dict(graph.components(edges).collect())
    assert got == {i: 10 for i in range(10, 61)} | {100: 100, 101: 100}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, S.op7_similar(spark, "/root/testdata/sf0.01").collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs])


def partly_laden(seed):
    """A group of two, of which one lacks the common passage, and a document that only the other links to through few shingles."""
    for k in range(seed, seed + 100_000):
        rng = random.Random(k)
        word = lambda: f"v{rng.randrange(10_000)}"
        passage, base = [word() for _ in range(6)], [word() for _ in range(12)]
        holds = base + passage
        asks, lacks = [word(), word(), *holds[2:]], holds[:-2]
        x, full, less, common = (S.shingles(" ".join(w)) for w in (asks, holds, lacks, passage))
        agree = lambda a, b: int((S.signature(a) == S.signature(b)).sum())
        of = lambda found: set(S.prefix(found, S.SHARE).tolist())
        laden = set(common.tolist())
        if laden <= of(x) & of(full) and len((of(x) & (of(full) | of(less))) - laden) == 2 and agree(full, less) >= 14 > max(agree(x, full), agree(x, less)):
            texts = [asks, holds, lacks] + [[word() for _ in range(5)] + passage + [word() for _ in range(5)] for _ in range(30)]
            return [(i, " ".join(t)) for i, t in enumerate(texts)]
    raise AssertionError


@pytest.mark.parametrize("seed", [0, 500_000])
def test_group_that_partly_lacks_the_common_passage(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "MANY", 3)
    monkeypatch.setattr(S, "AGREE", 14)
    rows = partly_laden(seed)
    assert brute(rows)[:3] == [(0, 14, 0), (1, 14, 0), (2, 12, 0)]
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_link_to_a_member_with_more_common_shingles(spark):
    a = "lkcmef leclnh langhp lcmnmj cgbjgk coakic bfhphf alpha beta gamma delta omega"
    b2 = " ".join(a.split()[-10:])
    rng = random.Random(4)
    fillers = ["alpha beta gamma delta omega " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(6)) for _ in range(90)]
    rows = list(enumerate([a, b2.rsplit(" ", 1)[0], b2, *fillers]))
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert brute(rows)[:3] == [(0, 8, 0), (1, 5, 0), (2, 6, 0)]


@pytest.mark.parametrize("seed,many", [(11, 1), (12, 4), (13, 64)])
def test_short_texts_with_common_phrases(spark, seed, many, monkeypatch):
    monkeypatch.setattr(S, "MANY", many)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10_000)}"
    phrases = [[word() for _ in range(rng.randrange(5, 10))] for _ in range(4)]
    rows = []
    for i in range(220):
        text = [word() for _ in range(rng.randrange(0, 3))] + rng.choice(phrases) + [word() for _ in range(rng.randrange(0, 3))]
        if rng.random() < 0.3:
            text = text + rng.choice(phrases)
        rows.append((i, " ".join(text)))
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("edits,block", [(5, 1_000), (9, 4_000)])
def test_family_of_which_few_link(spark, edits, block, monkeypatch):
    monkeypatch.setattr(S, "MANY", 8)
    monkeypatch.setattr(S, "BLOCK_SHINGLES", block)
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert len({c for _, _, c in brute(rows)}) > 1


def test_very_long_text_and_its_copy(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = list(long)
    for k in range(0, 60_000, 50):
        near[k] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:50_000])), (4, " ".join(long[:40_000])), (5, "x" * 300_000)]
    got = S.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
