"""Quality classifier from trusted positives and unlabelled text, by non-negative unbiased risk.

Labels of bad texts are never learned from. What there is: texts marked good (the
positives), and all texts, whose share of good ones is the class prior. With loss L and
prior p, the risk of a classifier g over good and bad texts is

    p * E_good[L(g)] + (E_all[L(-g)] - p * E_good[L(-g)])

in which the bracket is the risk on bad texts. It cannot be negative, so where a flexible
model drives it below zero on a batch, the step goes the other way for that part
(``fit_risk``).

1. One pass over the texts makes ``FEATURES`` dense figures of each whole text: shares
   of letters, capitals, digits, marks and symbols, how words end, repeated words and
   lines, lengths. They are written, 100 bytes a document; no text is read again or
   shuffled.
2. A small network learns to tell half of the positives from all texts. Its scores of the
   other half and of **all** documents, counted in Spark over the positives'
   quantiles, give the prior: good texts are found among all at no more than the rate
   the best bin shows (``class_prior``). The halves change places, and the mean counts.
3. A network of the same shape minimises the risk with that prior.
4. Every document is scored from its figures, in the tasks that hold them.

Fitting uses bounded samples drawn by a hash (``POSITIVES`` labelled rows, ``UNLABELLED``
rows of figures); the prior's counts cover all rows. The driver holds the samples (9 MB
at most); the networks (3 KB) go out with the tasks.

Cases: null and empty texts have the figures of no words and a score of their own; texts of any
length count whole; without any positive there is nothing to learn and every score is
0.5; labels other than 1 and rows without an id in ``labels`` are not positives, and
repeated ones count once; repeated documents count as often as they occur; equal texts have equal scores;
an empty table gives none; extra columns pass through ``scored``, and those with an
output's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.common import passing, place, read, slices, written

#: Labelled positives and unlabelled rows that a model may be fitted on, at most.
POSITIVES, UNLABELLED = 20_000, 60_000
#: From this score on a text is taken as good.
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1_200, 512, 0.01, 1e-4
#: Bins of the scores from which the prior is read, and standard errors by which it leans
#: to the low side: too high a prior leaves bad texts in, too low a one lowers scores a little.
BINS, LEAN = 200, 2.0
FEATURES = 24

# Byte classes.
SPACE, LOWER, UPPER, DIGIT, STOP, SYMBOL, BEYOND = range(7)
CLASS = np.full(256, BEYOND, np.uint8)
CLASS[:128] = SYMBOL
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[97:123], CLASS[65:91], CLASS[48:58] = LOWER, UPPER, DIGIT
CLASS[list(b".,;:?'\"()-")] = STOP


def figures(text: bytes | None) -> np.ndarray:
    """The dense figures of a whole text."""
    out = np.zeros(FEATURES, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    raw = np.frombuffer(text, np.uint8)
    kinds, counts = CLASS[raw], np.bincount(raw, minlength=256)
    of = np.bincount(CLASS, counts, 7)
    n, size, letters = len(words), len(raw), max(of[LOWER] + of[UPPER] + of[BEYOND], 1)
    solid = kinds != SPACE
    ends = np.flatnonzero(solid & np.append(~solid[1:], True))
    starts = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    last, first = np.bincount(kinds[ends], minlength=7) / n, np.bincount(kinds[starts], minlength=7) / n
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = sum(x.rstrip()[-1:] in b".?!" for x in lines)
    out[:] = (
        np.log1p(n), (ends - starts + 1).mean(), (ends - starts + 1).std(), len(seen) / n, max(seen.values()) / n, sum(map(eq, words, words[1:])) / n, np.log1p(n) * len(seen) / n,
        of[UPPER] / letters, of[DIGIT] / size, of[STOP] / size, of[SYMBOL] / size, of[BEYOND] / size, counts[33] / n, counts[63] / n, counts[[35, 36, 37, 38, 42]].sum() / n, counts[[60, 62, 91, 93, 123, 124, 125]].sum() / n,
        last[SYMBOL], last[STOP], last[UPPER], first[UPPER], first[SYMBOL], len(lines) / n, 1 - len(set(lines)) / len(lines), marks / len(lines),
    )
    return out


@dataclass
class Network:
    """One hidden layer over standardised figures."""

    mean: np.ndarray
    spread: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w + self.b) @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_risk(good: np.ndarray, every: np.ndarray, prior: float | None, seed: int = 3) -> Network:
    """Minimises the non-negative unbiased risk at a prior, or without one the plain risk of telling ``good`` from ``every``.

    Adam over batches of both, with logistic loss; the weights of the second half of the steps are averaged.
    """
    rng = np.random.default_rng(seed)
    net = Network(every.mean(0), np.maximum(every.std(0), 1e-3), rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    good, every = net.standard(good), net.standard(every)
    flat = np.concatenate([net.w.ravel(), net.b, net.v, [net.c]])
    m, s, total = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)

    def parts(at: np.ndarray):
        a, b = FEATURES * HIDDEN, FEATURES * HIDDEN + HIDDEN
        return at[:a].reshape(FEATURES, HIDDEN), at[a:b], at[b : b + HIDDEN], at[-1]

    for step in range(1, STEPS + 1):
        x = np.concatenate([good[rng.integers(len(good), size=BATCH)], every[rng.integers(len(every), size=BATCH)]])
        w, b, v, c = parts(flat)
        h = np.tanh(x @ w + b)
        p = _sigmoid(h @ v + c)
        of_good, of_every = slice(0, BATCH), slice(BATCH, None)
        d = np.zeros(2 * BATCH)  # the risk's derivative by each margin, times the batch's size
        if prior is None:
            d[of_good], d[of_every] = p[of_good] - 1, p[of_every]
        else:
            loss = -np.log(np.maximum(1 - p, 1e-12))
            bad = loss[of_every].mean() - prior * loss[of_good].mean()
            if bad >= 0:
                d[of_good], d[of_every] = prior * (p[of_good] - 1) - prior * p[of_good], p[of_every]
            else:
                d[of_good], d[of_every] = prior * p[of_good], -p[of_every]
        back = np.outer(d, v) * (1 - h * h)
        grad = np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]]) / BATCH + DECAY * flat
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        flat = flat - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        if 2 * step > STEPS:
            total += flat
    w, b, v, c = parts(total / (STEPS - STEPS // 2))
    return Network(net.mean, net.spread, w, b, v, float(c))


def class_prior(every: np.ndarray, good: np.ndarray) -> float:
    """The share of good texts among all, from counts of both by bins of falling score.

    Down to any score the share of all texts is at least the prior times that of the good
    ones. The bin counts where that bound is least with two standard errors in both shares.
    """
    n, k = every.sum(), good.sum()
    share, found = np.cumsum(every) / n, np.cumsum(good) / k
    off, missed = np.sqrt(share * (1 - share) / n), np.sqrt((found * (1 - found) + 1 / k) / k)
    sure = found - 2 * missed
    best = int(np.where(sure > 0, (share + 2 * off) / np.maximum(sure, 1e-12), np.inf).argmin())
    bound = share[best] / max(found[best], 1e-12)
    error = bound * np.hypot(off[best] / share[best], missed[best] / max(found[best], 1e-12))
    return float(np.clip(bound - LEAN * error, 0.01, 0.99))


@dataclass
class QualityModel:
    network: Network | None = None
    prior: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.network is None else self.network.score(x)


def held_back(doc_id: Column) -> Column:
    """Rows whose labels no quality model may learn from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, FEATURES)


def featured(df: DataFrame, text_col: str = "text", out: str = "figures") -> DataFrame:
    """The columns of ``df`` but for the text, and the figures of each whole text."""
    at = place(df, text_col)
    kept = [i for i in passing(df, [out]) if i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out, T.ArrayType(T.FloatType(), False))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = np.array([figures(t) for t in part.column(at).cast(pa.binary()).to_pylist()], np.float32).ravel()
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, FEATURES), pa.int32()), pa.array(made))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), column], names=schema.names)

    return df.mapInArrow(run, schema)


def sampled(rows: DataFrame, limit: int) -> np.ndarray:
    """Figures of ``limit`` rows at most, by a hash of the row, in its order."""
    n, key = rows.count(), F.xxhash64(*rows.columns)
    if n > limit:  # all below a part of the hash's range, with a little room, and of those the first
        rows = rows.where(key < F.lit(int(2**64 * min(1.0, 1.1 * limit / n)) - 2**63).cast("long"))
    table = rows.select(key.alias("key"), "figures").orderBy("key", "figures").limit(limit).toArrow()
    return _matrix(table.column("figures"))


def fit(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """rows: doc_id, figures, of all documents; labels: doc_id, quality, of those that may be learned from."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = sampled(rows.join(ids, "doc_id", "left_semi").select("doc_id", "figures"), positives)
    if not len(good):
        return QualityModel()
    every = sampled(rows.select("doc_id", "figures"), unlabelled)
    return QualityModel(fit_risk(good, every, prior := estimated_prior(rows, good, every)), prior)


def estimated_prior(rows: DataFrame, good: np.ndarray, every: np.ndarray) -> float:
    """The prior from all rows, as the mean over both halves of the positives; one positive is both halves."""
    halves = [good[0::2], good[1::2] if len(good) > 1 else good]
    judges = [fit_risk(h, every, None) for h in halves]
    asked = [judges[k].margin(halves[1 - k]) for k in (0, 1)]
    edges = [np.unique(np.quantile(m, np.linspace(0, 1, BINS + 1)))[1:-1] for m in asked]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(0))
            for k in (0, 1):
                found = np.searchsorted(edges[k], judges[k].margin(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int32()), pa.array(found, pa.int32())], names=["judge", "bin"])

    counted = [np.zeros(len(e) + 1) for e in edges]
    for r in rows.select("figures").mapInArrow(run, "judge int, bin int").groupBy("judge", "bin").count().collect():  # 2 * BINS rows at most
        counted[r.judge][r.bin] = r["count"]
    own = [np.bincount(np.searchsorted(edges[k], asked[k]), minlength=len(counted[k])) for k in (0, 1)]
    return float(np.mean([class_prior(counted[k][::-1], own[k][::-1]) for k in (0, 1)]))


def scored(rows: DataFrame, model: QualityModel, score_col: str = "score") -> DataFrame:
    """Replaces ``figures`` by the probability that a text is good."""
    at = place(rows, "figures")
    kept = [i for i in passing(rows, [score_col]) if i != at]
    schema = T.StructType([*(rows.schema.fields[i] for i in kept), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(model.score(_matrix(batch.column(at))), pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learns from labels of good texts that are not held out."""
    rows = written(featured(read(spark, sf_dir, "documents").select("doc_id", "text")))
    model = fit(rows, read(spark, sf_dir, "labels").where(~held_back(F.col("doc_id"))))
    return scored(rows, model).select(
        "doc_id",
        held_back(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
