"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of a text in lower case, hashed into rows of an
embedding table; a text is the mean of its rows, followed by a linear softmax.
Table and softmax are trained together by stochastic gradient descent in numpy.
A part of the sample set aside gives the temperature of the softmax and the score
below which a prediction should be rejected (column ``accepted``).

Training takes a bounded sample of each language (``SAMPLE`` distinct texts with the
smallest hashes), so a rare language keeps its texts at any input size and copies take
no one's place. Prediction reads each whole text
once in the task which reads it, without a shuffle; the softmax is folded into the
table, so a text costs one lookup for each subword. The model (2 MB at most for 8
languages) is the only broadcast.

Cases: a null text, or one without a letter, is ``und`` with score 0 and not
accepted; with no labelled rows at all every text is ``und``; extra columns pass
through, and those with an output's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.common import held_out, passing, place, read, slices

#: Distinct labelled texts of each language that a model may learn from, at most.
SAMPLE = 2_000
PARTS = 1_000_000_007
BUCKETS, DIM = 1 << 16, 16
SIZES = (2, 3, 4)
#: Bytes of a text that make one training example; a text gives several, over its whole length.
EXAMPLE, EXAMPLES = 240, 3
EPOCHS, RATE = 3, 4.0
PRECISION = 0.98
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def subwords(raw: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of the bytes."""
    raw = raw.astype(np.uint32)
    out, h = [], (raw ^ np.uint32(2_166_136_261)) * np.uint32(16_777_619)
    for n in range(2, min(max(SIZES), len(raw)) + 1):
        h = (h[:-1] ^ raw[n - 1 :]) * np.uint32(16_777_619)
        if n in SIZES:
            out.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.intp) if out else np.empty(0, np.intp)


def mean_row(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Mean of the found rows of a table."""
    return np.ones(len(found), table.dtype) @ table.take(found, 0) / np.float32(max(len(found), 1))


def prepared(text: str) -> bytes:
    return f" {text.lower()} ".encode("utf-8", "surrogatepass")


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket by language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, raw: bytes) -> np.ndarray:
        found = subwords(np.frombuffer(raw, np.uint8))
        return mean_row(self.table, found) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(prepared(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """rows: (text, language)."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    where = {lang: i for i, lang in enumerate(languages)}
    train, check = [], []
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    first = {lang: k for k, (_, lang) in reversed([*enumerate(rows)])}
    size = Counter(lang for _, lang in rows)
    for k, (text, lang) in enumerate(rows):
        raw = prepared(text)
        # of each language a run of texts that are neighbours in order is set aside, so that copies with the same beginning do not stand on both sides
        aside = len(rows) >= 50 and 5 * (k - first[lang] + 1) > 4 * size[lang]
        starts = [0] if len(raw) <= EXAMPLE else np.unique(np.linspace(0, len(raw) - EXAMPLE, EXAMPLES).astype(int))
        for a in starts:
            found = subwords(np.frombuffer(raw[a : a + EXAMPLE], np.uint8))
            if len(found):
                (check if aside else train).append((found, where[lang]))
    m = len(languages)
    if not m:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    table = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, m), np.float32), np.zeros(m, np.float32)
    steps, at = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            rate = RATE * (1 - at / steps)
            at += 1
            found, label = train[i]
            mean = mean_row(table, found)
            p = _softmax(mean @ out + bias)
            p[label] -= 1
            back = out @ p
            out -= rate * 0.05 * np.outer(mean, p)
            bias -= rate * 0.002 * p
            np.subtract.at(table, found, (rate / len(found) * back).astype(np.float32))
    model = LanguageModel(languages, (table @ out).astype(np.float32), bias, 1.0, 0.0)
    if check:
        logits = np.stack([mean_row(model.table, f) + bias for f, _ in check])
        labels = np.array([label for _, label in check])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = _softmax(logits / model.temperature)
        right, score = p.argmax(1) == labels, p.max(1)
        order = np.argsort(-score)
        precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(precision >= PRECISION)
        model.reject_below = float(score[order][enough[-1]]) if len(enough) else 1.0
    return model


def sample(df: DataFrame, limit: int = SAMPLE) -> list[tuple[str, str]]:
    """Of every language the ``limit`` distinct texts with the smallest hashes, or all; any order and partitioning of the rows gives the same."""
    hashed = df.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    # a little more than the bound passes by its hash, so that ranking has few rows however large a language is
    near = F.pmod("h", F.lit(PARTS)) * F.col("n") < F.lit(float(PARTS)) * (limit + 8 * limit**0.5 + 50)
    few = hashed.join(F.broadcast(sizes), "lang").where(near).dropDuplicates(["lang", "h", "text"])
    order = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(PARTS)), "h", "text")
    rows = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("text", "lang").collect()
    return sorted((r.text, r.lang) for r in rows)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``accepted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    at, kept = place(df, text_col), passing(df, [f.name for f in new])
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *new])

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                found = [own.predict(t) for t in part.column(at).to_pylist()]
                columns = list(zip(*found)) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_())))], names=schema.names)

    return df.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learns from rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(sample(docs.where(~held_out(F.col("doc_id")))))
    out = predict(docs.drop("lang"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
