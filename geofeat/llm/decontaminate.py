r"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and other characters beyond ASCII, with A-Z in
lower case. Of the hashes of all ``K``-word grams a text keeps the minimum of every
``SPAN - K + 1`` neighbours; two texts which share ``SPAN`` words in a row therefore
share a kept hash, whatever stands around them. Documents which share one with a
benchmark item are candidates; in them the hits are extended: every window of
``SPAN`` words that equals a window of an item marks its words. Items of fewer words
are one window each, found through their longest word instead of a kept hash.

DataFrame functions only. The first pass reads each document once and sends on one
row and what it shares with the benchmark; the second pass reads the candidates'
texts again. The benchmark's hashes and windows, and the candidates' keys, are sent
to all tasks while they are counted to be at most ``BROADCAST_ROWS``; beyond that
the same joins shuffle. A passage that very many documents share stays a row for
each document and place: documents are not paired.

Cases: null and empty texts have no words, are not contaminated and, as items, hit
nothing; documents that share an id are told apart by their text, equal rows give
equal results; a null id is a key like any other; items that share an id count
once; without items no word is hit; other columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofeat.llm.common import read, written

SPAN, K = 10, 5
BROADCAST_ROWS = 1_000_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; A-Z are made small, letters beyond ASCII stay as they are."""
    text = F.coalesce(text, F.lit(""))
    small = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.array_remove(F.split(small, BETWEEN), "")


def key_of(text: Column) -> Column:
    """The hash by which rows with equal ids are told apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _lower(a: Column, b: Column) -> Column:
    return F.least(a, b)


def winnowed(df: DataFrame, out: str = "prints") -> DataFrame:
    """Replaces the column ``words`` by ``n_words``, ``longest`` words' hashes and the kept hashes ``out``."""
    rest = [c for c in df.columns if c != "words"]
    n = F.size("words")
    gram = F.transform(F.slice("words", F.lit(1), n - (K - 1)), lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, K)]))
    hashed = df.select(*rest, n.cast("long").alias("n_words"), F.when(n >= K, gram).otherwise(_nothing("bigint")).alias("h1"))
    shifted = lambda c, k: F.slice(c, F.lit(k + 1), F.greatest(F.size(c), F.lit(0)))
    pairs = hashed.select(*rest, "n_words", F.zip_with("h1", shifted("h1", 1), _lower).alias("h2"))
    fours = pairs.select(*rest, "n_words", "h2", F.zip_with("h2", shifted("h2", 2), _lower).alias("h4"))
    # minima of SPAN - K + 1 = 6 neighbours; the last ones, of fewer, only add candidates
    return fours.select(*rest, "n_words", F.array_distinct(F.zip_with("h4", shifted("h2", 4), _lower)).alias(out))


def windows_of(words: str, lengths: list[int]) -> Column:
    """Array of (at, len, window) for the given numbers of words; a window is its words joined by spaces."""


    def of(m: int) -> Column:
        own = F.transform(F.slice(words, F.lit(1), F.size(words) - (m - 1)), lambda w, i: F.struct(i.alias("at"), F.lit(m).alias("len"), F.array_join(F.slice(words, i + 1, m), " ").alias("window")))
        return F.when(F.size(words) >= m, own).otherwise(_nothing("struct<at:int,len:int,window:string>"))

    return F.concat(*map(of, lengths))


def _sent(df: DataFrame) -> DataFrame:
    """Marks a frame for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, text_key (a hash of its text), n_words, the hit words' places as an array, and the ids of the items that hit."""
    own = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    lengths = sorted(r[0] for r in own.select(F.least(F.size("words"), F.lit(SPAN))).distinct().collect())
    short = [m for m in lengths if m < SPAN]
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    marks = winnowed(own.where(F.size("words") >= SPAN)).select(F.explode("prints").alias("print"))
    if short:
        marks = marks.union(own.where(F.size("words") < SPAN).select(F.xxhash64(longest)))
    marks = _sent(marks.distinct().withColumn("found", F.lit(True)))
    own_windows = own.select("item", F.least(F.size("words"), F.lit(SPAN)).alias("m"), "words")
    own_windows = own_windows.select("item", F.explode(windows_of("words", lengths)).alias("x"), "m").where("x.len = m").select("item", "x.window").distinct() if lengths else own_windows.select("item", F.lit("").alias("window"))

    text_key = key_of(F.col(text)).alias("text_key")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key, words_of(F.col(text)).alias("words"))
    if short:
        keyed = keyed.withColumn("extra", F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))))
    kept = winnowed(keyed)
    prints = F.concat(F.array(F.lit(None).cast("bigint")), "prints", *(["extra"] if short else []))
    # each document's first row, without a hash, carries it through the join
    spread = kept.select("doc_id", "text_key", "n_words", F.explode(prints).alias("print"))
    met = spread.join(marks, "print", "left").where(F.col("print").isNull() | F.col("found"))
    counted = met.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.max(F.coalesce("found", F.lit(False))).alias("candidate"), F.count(F.when(F.col("print").isNull(), 1)).alias("rows"))
    first = written(counted)

    candidates = _sent(first.where("candidate").select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")))
    again = docs.select(F.col(doc_id).alias("doc_id"), text_key, F.col(text).alias("text"))
    again = again.join(candidates, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left_semi")
    placed = again.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    placed = placed.select("doc_id", "text_key", F.explode(windows_of("words", lengths or [SPAN])).alias("x")).select("doc_id", "text_key", "x.at", "x.len", "x.window")
    matched = placed.join(_sent(own_windows), "window").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "len")).alias("spans"), F.collect_set("item").alias("items"))
    matched = matched.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))).alias("places"), F.array_sort("items").alias("items"))
    joined = first.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    repeated = joined.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return repeated.select("doc_id", "text_key", "n_words", F.coalesce("places", _nothing("int")).alias("places"), F.coalesce("items", _nothing("string")).alias("items"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    found = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM m) x),
l AS (SELECT DISTINCT m FROM m),
d AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM t, l) x),
h AS (SELECT d.doc_id, d.i, d.m, k.item_id FROM d JOIN k ON d.g = k.g AND d.m = k.m),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(m)) AS j FROM h) x GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) x GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN p ON t.doc_id = p.doc_id LEFT JOIN q ON t.doc_id = q.doc_id"""
