"""Quality rules whose thresholds adapt to each language and source.

Base figures of a text come from its words: symbols, repeated lines, repeated
three-word windows, word lengths. A text fails outright when it has few words or
mostly repeats itself. The others are held against thresholds which mergeable
quantile sketches give for their (language, source): per group and figure, counts
in buckets of two significant digits, so that any two sketches merge by adding
counts, in any order, with the same result. A group's sketch is merged with that of
its language and that of all texts, each weighing as much as ``PRIOR`` texts: a small
group leans on them, a large one speaks for itself. A figure is an outlier beyond its
upper quantile (``FIGURES``) plus ``REACH`` times that quantile's distance from the
median plus a small slack, the step which a single odd line or word makes in a short
text; word lengths are held from below in the same way.

DataFrame functions only. Each text is reduced to its figures in the task that
reads it; the shuffles carry bucket counts (partial sums first, so that a hot
source stays even) and the join brings back a threshold table of at most one row
per (language, source).

Cases: a null or empty text has no words and fails the base rules; null languages
and sources form groups of their own; an empty table gives no rows; other columns
are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geofeat.llm.common import read, written

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words in repeated windows
#: Texts that the sketches of the language and of all texts weigh in a group's; spreads beyond the upper quantile.
PRIOR, REACH = 20, 2
#: Figures per text that must not be outliers: the upper quantile in percent, and the slack.
FIGURES = {"symbols_per_1000_words": (90, 100), "dup_lines_per_1000": (99, 100), "repeated_per_1000_words": (99, 50), "chars_per_100_words": (90, 20)}
#: The figure that is held from below too, by the quantile as far from the other end.
BOTH_SIDES = "chars_per_100_words"
#: Weight of one text; priors weigh whole parts of it, so that sums are exact.
ONE = 1_000


def base_figures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to the kept columns."""
    text = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = df.select(
        *keep,
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("words")
    windows = F.transform(F.slice("words", F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    hashed = split.select(
        *keep, "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = hashed.select(
        *[c for c in hashed.columns if c != "windows"],
        F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"),
    )
    again = F.filter("placed", lambda x, j: (x["h"] == F.get("placed", j + 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("placed", j - 1)["h"]).eqNullSafe(True))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return placed.select(*[c for c in placed.columns if c != "placed"], F.when(F.col("placed").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def ratio(a: str, b: str, scale: int) -> Column:
    return F.expr(f"{scale} * {a} div greatest({b}, 1)")


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "symbols_per_1000_words": ratio("n_symbols", "n_words", 1000),
        "dup_lines_per_1000": ratio("n_dup_lines", "n_lines", 1000),
        "repeated_per_1000_words": ratio("n_repeat_words", "n_words", 1000),
        "chars_per_100_words": ratio("word_chars", "n_words", 100),
    })


def sketches(df: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches: counts by group, figure and bucket of two significant digits."""
    long = df.select(*by, F.expr(f"stack({len(FIGURES)}, {', '.join(f'{chr(39)}{f}{chr(39)}, {f}' for f in FIGURES)}) as (figure, value)"))
    digits = F.length(F.col("value").cast("string"))
    step = F.expr("cast(pow(10, greatest(length(cast(value as string)) - 2, 0)) as bigint)")
    bucket = F.when(digits <= 2, F.col("value")).otherwise((F.expr("value") / step).cast("long") * step)
    return long.groupBy(*by, "figure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """lang, source, figure, bucket, weight: each group's sketch with those of its language and of all texts."""
    total = lambda *by: F.sum("n").over(W.partitionBy(*by, "figure"))
    prior = lambda n, all: F.expr(f"{PRIOR * ONE} * {n} div {all}").alias("weight")
    by_lang = sketch.groupBy("lang", "figure", "bucket").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("figure", "bucket").agg(F.sum("n").alias("n")).withColumn("total", total()).select(F.col("figure").alias("f"), "bucket", prior("n", "total"))
    of_lang = by_lang.withColumn("total", total("lang")).select(F.col("lang").alias("l"), F.col("figure").alias("f"), "bucket", prior("n", "total"))
    groups = sketch.select("lang", "source", "figure").distinct()
    columns = ["lang", "source", "figure", "bucket", "weight"]
    parts = [
        sketch.withColumn("weight", F.col("n") * ONE),
        groups.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("figure") == F.col("f"))),
        groups.join(F.broadcast(of_all), F.col("figure") == F.col("f")),  # at most 90 buckets for each figure and power of ten
    ]
    return parts[0].select(columns).union(parts[1].select(columns)).union(parts[2].select(columns)).groupBy(*columns[:-1]).agg(F.sum("weight").alias("weight"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Per (t_lang, t_source): the highest value of each figure that is no outlier, and the lowest of the one held on both sides."""
    group = W.partitionBy("lang", "source", "figure")
    placed = blended(sketch).select("lang", "source", "figure", "bucket", F.sum("weight").over(group.orderBy("bucket")).alias("upto"), F.sum("weight").over(group).alias("total"))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bucket")))
    of = lambda f: F.col("figure") == f
    upper = {f: at(q) for f, (q, _) in FIGURES.items()}
    figure = placed.groupBy("lang", "source", "figure").agg(at(50).alias("q50"), F.coalesce(*(F.when(F.first("figure") == f, x) for f, x in upper.items())).alias("high"), at(100 - FIGURES[BOTH_SIDES][0]).alias("low"))
    top = {f: F.max(F.when(of(f), F.col("high") + REACH * (F.col("high") - F.col("q50")) + slack)).alias(f"max_{f}") for f, (_, slack) in FIGURES.items()}
    bottom = F.max(F.when(of(BOTH_SIDES), F.col("low") - REACH * (F.col("q50") - F.col("low")) - FIGURES[BOTH_SIDES][1])).alias(f"min_{BOTH_SIDES}")
    return figure.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*top.values(), bottom)


def judged(figures: DataFrame) -> DataFrame:
    """Adds base_failed and kept; figures: columns of ``base_figures`` with lang and source."""
    df = with_ratios(figures).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    fences = thresholds(sketches(df.where(~F.col("base_failed")), ["lang", "source"]))
    joined = df.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    good = F.col(BOTH_SIDES) >= F.coalesce(F.col(f"min_{BOTH_SIDES}"), F.col(BOTH_SIDES))
    for f in FIGURES:
        good = good & (F.col(f) <= F.coalesce(F.col(f"max_{f}"), F.col(f)))
    return joined.withColumn("kept", ~F.col("base_failed") & good)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict for every document."""
    figures = written(base_figures(read(spark, sf_dir, "documents")))
    return judged(figures).select(*COLUMNS)


def _sql() -> str:
    ws = "[^\\x20\\x09-\\x0D]+"
    longs = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS figure, {f} AS value FROM r WHERE NOT base_failed" for f in FIGURES)
    case = lambda i: " ".join(f"WHEN '{f}' THEN {v[i]}" for f, v in FIGURES.items())
    picks = ", ".join(f"max(CASE WHEN figure = '{f}' THEN fence END) AS max_{f}" for f in FIGURES)
    good = " AND ".join(f"r.{f} <= coalesce(t.max_{f}, r.{f})" for f in FIGURES) + f" AND r.{BOTH_SIDES} >= coalesce(t.min_{BOTH_SIDES}, r.{BOTH_SIDES})"
    at = lambda p: f"min(CASE WHEN 100 * upto >= {p} * total THEN bucket END)"
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{ws}') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{ws}')) AS lines FROM documents),
x3 AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM x3) x WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
r AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols_per_1000_words, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines_per_1000,
             1000 * n_repeat_words // greatest(n_words, 1) AS repeated_per_1000_words, 100 * word_chars // greatest(n_words, 1) AS chars_per_100_words,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM f),
v AS ({longs}),
b AS (SELECT lang, source, figure, CASE WHEN value < 100 THEN value ELSE value // CAST(pow(10, length(CAST(value AS VARCHAR)) - 2) AS BIGINT) * CAST(pow(10, length(CAST(value AS VARCHAR)) - 2) AS BIGINT) END AS bucket FROM v),
k AS (SELECT lang, source, figure, bucket, count(*) AS n FROM b GROUP BY ALL),
l AS (SELECT lang, figure, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, figure) AS total FROM k GROUP BY lang, figure, bucket),
a AS (SELECT figure, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY figure) AS total FROM k GROUP BY figure, bucket),
g AS (SELECT DISTINCT lang, source, figure FROM k),
m AS (SELECT lang, source, figure, bucket, {ONE} * n AS weight FROM k
      UNION ALL SELECT g.lang, g.source, g.figure, l.bucket, {PRIOR * ONE} * l.n // l.total FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.figure = l.figure
      UNION ALL SELECT g.lang, g.source, g.figure, a.bucket, {PRIOR * ONE} * a.n // a.total FROM g JOIN a ON g.figure = a.figure),
s AS (SELECT lang, source, figure, bucket, sum(weight) AS weight FROM m GROUP BY ALL),
c AS (SELECT lang, source, figure, bucket, sum(weight) OVER (PARTITION BY lang, source, figure ORDER BY bucket) AS upto, sum(weight) OVER (PARTITION BY lang, source, figure) AS total FROM s),
q AS (SELECT lang, source, figure, {at(50)} AS q50, {at("CASE figure " + case(0) + " END")} AS high, {at(100 - FIGURES[BOTH_SIDES][0])} AS low FROM c GROUP BY lang, source, figure),
e AS (SELECT lang, source, figure, high + {REACH} * (high - q50) + CASE figure {case(1)} END AS fence, low - {REACH} * (q50 - low) - {FIGURES[BOTH_SIDES][1]} AS least FROM q),
t AS (SELECT lang, source, {picks}, max(CASE WHEN figure = '{BOTH_SIDES}' THEN least END) AS min_{BOTH_SIDES} FROM e GROUP BY lang, source)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {good} AS kept
FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source"""


OP2_SQL = _sql()
