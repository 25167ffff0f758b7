"""The manifest against a plain tree, and against its SQL."""

import glob
import hashlib
import random
import zlib

import duckdb
import pytest

from geofeat.llm import merkle as mk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, siblings with sides of each node)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            paths[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    below = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    root, above = tree([below[g][0] for g in langs])
    out = []
    for g, top in zip(langs, above):
        for r, path in zip(groups[g], below[g][1]):
            path, now = path + top, r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            fold = leaf(now)
            for a, b in path:
                fold = H(a, fold, b)
            out.append((r[0], leaf(r), below[g][0], root, H(*(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "ÄÖ", "é", "", "x\ny", "12:3", "-"]
    out = [(k * 3, " ".join(rng.choices(words, k=rng.randrange(5))), rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([None, 5])) for k in range(n)]
    return out


CASES = {
    "one": [(7, "Only", "en", "s", 4)],
    "nulls": [(None, None, None, None, None), (None, "a", None, None, 1), (3, None, "", "-", None), (3, "", "", "", 0)],
    "copies": [(5, "Same Text", "en", "s", 9)] * 20 + [(5, "Other", "en", "s", 5)] * 3,
    "runs": rows_of(8, ["en"], 1) + rows_of(9, ["de"], 2) + rows_of(64, ["fr"], 3) + rows_of(65, ["es"], 4),
    "blocks": rows_of(512, ["en"], 5) + rows_of(513, ["de"], 6) + rows_of(4_200, ["fr"], 7),
    "many groups": rows_of(1_300, [f"l{k}" for k in range(600)] + [None, "", "é"], 8),
    "long": [(1, "Wort " * 200_000, "en", "s", 1), (2, "b", "en", "s", 1), (3, "C", "en", "s", 1)],
}


@pytest.mark.parametrize("case", CASES)
def test_query_equals_a_plain_tree(spark, tmp_path, case):
    spark.createDataFrame(CASES[case], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mk.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(CASES[case])


def test_a_third_round_of_blocks(spark, tmp_path, monkeypatch):
    """Blocks of 8 nodes, so that 700 rows take four rounds."""
    monkeypatch.setattr(mk, "LEVELS", 1)
    monkeypatch.setattr(mk, "BLOCK", 8)
    rows = rows_of(700, ["en", "en", "de"], 9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, mk.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == expected(rows)


def test_query_equals_sql(spark, tmp_path):
    rows = CASES["runs"] + CASES["nulls"] + rows_of(700, ["en", None, "pt"], 11)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{glob.glob(f'{tmp_path}/documents.parquet/*.parquet')[0]}'")
    got = mk.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == [c[0] for c in con.execute(mk.OP12_SQL).description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(mk.OP12_SQL).fetchall(), key=str)


def test_no_rows_and_columns_that_ride_along(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert mk.op12_merkle_manifest(spark, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(k, "g", H(str(k)), f"more{k}") for k in range(20)], "id int, part string, leaf string, Root_of string")
    found = mk.proofs(rows, "part", ["id"])
    assert found.columns == ["id", "part", "leaf", "Root_of", "subroot", "root", "path"]
    assert found.where(mk.folded(mk.F.col("leaf"), mk.F.col("path")) == mk.F.col("root")).count() == 20
    assert found.select("root").distinct().count() == 1 and {r.Root_of for r in found.collect()} == {f"more{k}" for k in range(20)}
