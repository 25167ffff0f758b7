import duckdb

from geofeat.llm import quality as Q


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z", "é# 😀 |<>|\x0b\x0c\x85w", "a a a a"] + ["w%d v " % i * 30 for i in range(3)]


def test_base_figures(spark):
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, words int")
    for r in Q.base_figures(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    assert Q.judged(Q.base_figures(df)).where("kept is null or base_failed is null").count() == 0
    assert Q.judged(Q.base_figures(df.where("false"))).count() == 0


def test_outlier_goes_and_prose_stays(spark):
    prose = " ".join(f"word{i}" for i in range(200))
    rows = [(i, prose + f" end{i}", "en", "a") for i in range(40)] + [(99, " ".join(f"w{i} ###" for i in range(100)), "en", "a"), (100, prose + " more", "en", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.judged(Q.base_figures(df)).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = con.execute(Q.OP2_SQL).fetchall()
    got = [tuple(r) for r in Q.op2_quality_rules(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(expected)
