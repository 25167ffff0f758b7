"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of an abuse lexicon (fixed words, and words
and word stems which the training labels single out), how near second-person
words stand to its hits, capitals, exclamation and question marks, and rates of
obfuscated words (letters mixed with digits or signs, stretched letters). Boosted
trees score them, and an isotonic fit on rows kept apart turns scores into
probabilities.

Training uses a bounded sample of the labelled rows, drawn by a hash of their ids
(``SAMPLE``), in three folds. One Spark aggregation counts the words and stems, of
which the driver takes the ``2 * LEXICON`` best; lexicon, trees and calibration are
crossed over the folds, so each sees rows that did not make its inputs. Scoring reads each text once in the task which reads it: no shuffle;
the model (below 1 MB) is the only broadcast.

Cases: null and empty texts have the features of no words and get the score which
the model gives those; rows without a label do not train; where no usable row, or
none of one of the two classes, is there to learn from, the fixed lexicon alone scores
(0.9 with a hit, else 0.05), and any number of rows of both trains the trees; repeated labels of one id count as often as they occur; extra columns pass
through, and those with an output's name are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.boosting import BoostedTrees, Isotonic
from geofeat.llm.common import held_out, passing, place, read, slices

#: Labelled rows that a model may learn from, and learned lexicon entries, at most.
SAMPLE, LEXICON = 24_000, 2_000
THRESHOLD = 0.3
#: Lexicon entries need this many toxic documents and this share of them, this log-likelihood weight and this lift.
MIN_DOCS, MIN_SHARE, MIN_WEIGHT, MIN_LIFT = 4, 0.01, 9.0, 12
FOLDS, N_TREES, DEPTH = 3, 40, 3
NEAR = 5

# Abuse words and second-person words.
ABUSE = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum clown worthless pathetic disgusting garbage filth vermin imbecile jerk creep "
    "bastard bitch crap shit fuck fucking asshole whore slut retard retarded "
    "idiotisch dumm dummkopf arschloch scheisse scheiße abschaum hurensohn wertlos ekelhaft "
    "idiote imbécile connard connasse salaud merde crétin abruti dégoûtant "
    "idiota imbécil estúpido estupido mierda cabrón puta asqueroso".split()
)
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu toi vous votre vos tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")

FIXED, YOU, MIXED, STRETCHED, CAPS, STEM, LEARNED = 1, 2, 4, 8, 16, 32, 64
HIT = FIXED | STEM | LEARNED
STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "…“”‘’«»¿¡–—"
INNER = re.compile(r"[^\W\d_][\d@$!*#%+]+[^\W\d_]")
AGAIN = re.compile(r"([^\W\d_])\1\1")
REMEMBERED = 100_000
FEATURES = 17


def stems(word: str) -> list[str]:
    """Prefixes of a word which may stand in a learned lexicon, marked by a star."""
    return [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: BoostedTrees | None = None
    isotonic: Isotonic = field(default_factory=Isotonic)

    def __post_init__(self):
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "trees": self.trees, "isotonic": self.isotonic, "known": {}}

    def code(self, token: str) -> int:
        """What a token between spaces is, as bits."""
        bare = token.strip(STRIP)
        word = bare.lower()
        plain = word.translate(LEET) if not word.isalpha() else word
        code = 0
        for form, odd in ((word, 0), (plain, MIXED)):
            if form in ABUSE:
                code |= FIXED | odd
            if form in self.lexicon:
                code |= LEARNED | odd
            if odd == 0 and any(s in self.lexicon for s in stems(form)):
                code |= STEM
            if code & HIT or plain == word:
                break
        if word in SECOND:
            code |= YOU
        if INNER.search(bare):
            code |= MIXED
        if AGAIN.search(word):
            code |= STRETCHED
        if len(bare) > 1 and bare.isupper():
            code |= CAPS
        return code

    def codes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint8, len(tokens))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = self.code(t)
            return np.fromiter(map(known.__getitem__, tokens), np.uint8, len(tokens))

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        out = np.zeros(FEATURES)
        codes = self.codes(text.split())
        n = max(len(codes), 1)
        hits, you = np.flatnonzero(codes & HIT), np.flatnonzero(codes & YOU)
        counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size, upper = max(counts.sum(), 1), counts[65:91].sum()
        letters = max(upper + counts[97:123].sum(), 1)
        near = 0
        if len(hits) and len(you):
            right = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - hits), np.abs(hits - you[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        rate = lambda bit: np.count_nonzero(codes & bit) / n
        out[:] = (
            len(hits) / n, np.log1p(len(hits)), rate(FIXED), rate(STEM), rate(LEARNED), np.count_nonzero((codes & (STEM | LEARNED)) == STEM | LEARNED) / n, near / max(len(hits), 1), np.log1p(near), len(you) / n, upper / letters, rate(CAPS),
            counts[33] / size, counts[63] / size, (counts[35:39].sum() + counts[42]) / size, rate(MIXED), rate(STRETCHED), np.log1p(n),
        )
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.where(x[:, 1] > 0, 0.9, 0.05)
        return np.clip(self.isotonic(self.trees.margin(x)), 0.0, 1.0)


def sampled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Labelled documents which may train, about ``limit`` at most, each in a fold."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = usable.count()
    key = F.pmod(F.xxhash64("doc_id"), F.lit(3_000_000))
    if n > limit:
        usable = usable.where(key < int(3e6 * 0.95 * limit / n))
    usable = usable.withColumn("part", (key % FOLDS).cast("int"))
    if n <= limit or usable.count() <= 2 * limit:  # the sample's size is checked before it is sent out
        usable = F.broadcast(usable)
    return docs.select("doc_id", "text").join(usable, "doc_id")


def lexicon_counts(rows: DataFrame, limit: int = LEXICON) -> tuple[list[tuple[str, list[int], list[int]]], list[int], list[int]]:
    """Entries which stand out in toxic rows, with toxic and all documents by fold; the folds' sizes likewise."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    forms = lambda w: F.filter(F.array(w, *(F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in (4, 5, 6))), lambda e: e.isNotNull() & (F.length(e) > 2))
    entries = rows.select("toxic", "part", F.explode(F.array_distinct(F.flatten(F.transform(words, forms)))).alias("entry"))
    of = [F.sum(F.when(F.col("part") == k, x).otherwise(0)) for x in (F.col("toxic"), F.lit(1)) for k in range(FOLDS)]
    named = [c.alias(f"c{i}") for i, c in enumerate(of)]
    sizes = rows.agg(*named).first()
    t, n = ([int(x or 0) for x in sizes[i : i + FOLDS]] for i in (0, FOLDS))
    if not sum(t):
        return [], t, n
    ct, cn = (sum((F.col(f"c{i}") for i in range(j, j + FOLDS)), F.lit(0)) for j in (0, FOLDS))
    least = max(MIN_DOCS, int(MIN_SHARE * sum(t) * (FOLDS - 1) / FOLDS))
    weight = ct * F.log((ct + 0.5) / (sum(t) + 1) / ((cn - ct + 0.5) / (sum(n) - sum(t) + 1)))
    top = entries.groupBy("entry").agg(*named).where((ct >= least) & (weight >= MIN_WEIGHT)).orderBy(weight.desc(), "entry").limit(2 * limit).collect()
    return [(r.entry, list(r[1 : FOLDS + 1]), list(r[FOLDS + 1 :])) for r in top], t, n


def chosen(counts, t: list[int], n: list[int], without: int | None = None, limit: int = LEXICON) -> frozenset[str]:
    """Entries of the lexicon which all folds give, or all but one."""
    keep = [k for k in range(FOLDS) if k != without]
    all_t, all_n = sum(t[k] for k in keep), sum(n[k] for k in keep)
    found = []
    for entry, ts, ns in counts:
        a, b = sum(ts[k] for k in keep), sum(ns[k] for k in keep)
        lift = (a + 0.5) / (all_t + 1) / ((b - a + 0.5) / (all_n - all_t + 1))
        if a >= max(MIN_DOCS, MIN_SHARE * all_t) and lift > MIN_LIFT and a * np.log(lift) >= MIN_WEIGHT:
            found.append((-a * np.log(lift), entry))
    return frozenset(e for _, e in sorted(found)[:limit])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic.

    Trees see each row with a lexicon that the other folds gave, and the calibration
    sees each row with trees that the other folds gave.
    """
    rows = sampled(docs, labels, limit).dropDuplicates(["text", "toxic", "part"])
    counts, t, n = lexicon_counts(rows)
    model = ToxicityModel(chosen(counts, t, n))
    folds = [ToxicityModel(chosen(counts, t, n, k)) for k in range(FOLDS)]
    got = featured(rows, folds).orderBy("doc_id", "toxic").collect()
    if not 0 < sum(r.toxic for r in got) < len(got):
        return model
    x, y, part = np.array([r.features for r in got]), np.array([r.toxic for r in got], float), np.array([r.part for r in got])
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[part == k] = BoostedTrees(N_TREES, DEPTH).fit(x[part != k], y[part != k]).margin(x[part == k])
    model.isotonic = Isotonic().fit(margin, y)
    model.trees = BoostedTrees(N_TREES, DEPTH).fit(x, y)
    return model


def featured(rows: DataFrame, folds: list[ToxicityModel]) -> DataFrame:
    """Features of training rows, by the model of each row's fold."""
    shared = rows.sparkSession.sparkContext.broadcast(folds)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, which = part.column(3).to_pylist(), part.column(2).to_pylist()
                x = [shared.value[k].features(t) for t, k in zip(texts, which)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "features"])

    rows = rows.select("doc_id", "toxic", "part", "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("features", T.ArrayType(T.DoubleType()))]))


def scored(df: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at, kept = place(df, text_col), passing(df, [score_col])
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                x = np.array([own.features(t) for t in part.column(at).to_pylist()]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(own.score(x), pa.float64())], names=schema.names)
        own.known.clear()  # the worker lives on

    return df.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learns from labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
