"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every word of a text is predicted from ``SIDE`` words on each side of it, itself
masked; the sum of the conditional log-probabilities is the text's score. A word's
probability is P(class | both sides) * P(word | class). Classes are the ``KNOWN`` most
frequent words of the corpus, and ``BUCKETS`` hash buckets of word endings, which
share out all other words. The network gives the first factor: an embedding for each
context word, weighted by its place, summed, and a softmax over classes. The second
is the word's share of its class in the counts of all words of the corpus; one
occurrence is set aside for words that the corpus does not have, and shared by as many
of them as the class has words.

The corpus makes the model, and the model grows with it: the counts have every
distinct word, and the square root of the corpus' words is the number of further
words with an embedding of their own (others have their class's). Word counts are a
Spark aggregation over all texts; the network starts from the classes' frequencies. It
trains in ``ROUNDS`` rounds, among which the texts are dealt by a hash, so that every
position trains once: tasks sum up the gradient of their positions in numpy, all at the
same weights, a Spark aggregation adds up the sums, and the driver makes one step with
momentum. How the texts are split into tasks only changes the order in which sums are
added. The driver holds and
sends out the weights, the words with an embedding and two numbers for each bucket;
the counts of all other words stay in Spark, which joins them by a 64-bit key (its
collisions aside, exactly).

Cases: null and empty texts have no words, a log-probability of 0 and a null mean; a
word alone is predicted from the edges; an empty table gives no rows; repeated rows train
and score each, alike; very long texts train and score whole, some thousand places at
a time, beside an array of all their words; extra columns pass through, and those with
an output's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.common import passing, read, slices, written
from geofeat.sources.shared import Scratch

KNOWN, BUCKETS, DIM, SIDE = 96, 32, 16, 2
CLASSES = KNOWN + BUCKETS
EDGE = CLASSES  # the context class beyond either end
ONES = np.ones((CLASSES, 1), np.float32)  # its product sums up rows faster than sum does
OFFSETS = tuple(d for d in range(-SIDE, SIDE + 1) if d)
#: Every text trains in one of the rounds; each makes one step, and the last ones are shorter.
ROUNDS, RATE, LAST_RATE = 10, 0.18, 0.036
MOMENTUM, SPREAD = 0.5, 0.95
#: An embedding moves half as far as others where a round met its word this often.
HALFWAY = 30
SCORED_AT_ONCE, SUMMED_AT_ONCE = 1_024, 2_048
#: Rows of a matrix product at once: so few that the numerics library stays in the task's own thread, where it would else spin on the cores of others.
ROWS_AT_ONCE = 128
REMEMBERED, COUNTED_AT_ONCE, SENT_AT_ONCE = 300_000, 200_000, 10_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-3:]) % BUCKETS


def with_one(x: np.ndarray) -> np.ndarray:
    """x with a one behind each row."""
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    return out


def product(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights in one thread."""
    out = np.empty((len(x), weights.shape[1]), np.float32)
    for a in range(0, len(x), ROWS_AT_ONCE):
        np.matmul(x[a : a + ROWS_AT_ONCE], weights, out=out[a : a + ROWS_AT_ONCE])
    return out


def product_over_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y in one thread."""
    out = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for a in range(0, len(x), ROWS_AT_ONCE):
        out += x[a : a + ROWS_AT_ONCE].T @ y[a : a + ROWS_AT_ONCE]
    return out


def key_of(word: bytes) -> int:
    """Key of a word in a bucket: negative, the bucket in its last bits."""
    return (xxhash.xxh3_64_intdigest(word) | 1 << 63) // BUCKETS * BUCKETS + bucket(word) - (1 << 64)


@dataclass
class Alphabet:
    """Word to class, to row of the embeddings, and to its share of its class."""

    known: dict[bytes, int]
    #: Further words with an embedding, and what they occur, in the order of their rows after EDGE.
    further: dict[bytes, int] = field(default_factory=dict)
    #: Occurrences and distinct words of each bucket; without them only classes are scored.
    totals: np.ndarray | None = None
    distinct: np.ndarray | None = None
    share: np.ndarray | None = None  # relative frequency of each class
    counts: DataFrame | None = None  # key, n: every word in a bucket; stays with the driver
    memo: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.rows = {w: EDGE + 1 + i for i, w in enumerate(self.further)} | self.known
        ends = np.array([bucket(w) for w in self.further], np.int64)
        self.class_of = np.concatenate([np.arange(CLASSES + 1), KNOWN + ends])
        self.of_row = np.zeros(len(self.class_of))
        if self.totals is not None:
            self.of_row[KNOWN:CLASSES] = -np.log(self.totals + 1)
            self.of_row[CLASSES + 1 :] = np.log(np.array(list(self.further.values()), float)) - np.log(self.totals[ends] + 1)

    def __getstate__(self):
        return self.__dict__ | {"counts": None, "memo": {}}

    def classes(self, text: str | None) -> np.ndarray:
        return self.class_of[self.placed(text)[0]]

    def placed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a text's words, and the keys of those words that have no row of their own."""
        codes = self._codes(text)
        other = codes < 0
        return np.where(other, KNOWN + (codes & (BUCKETS - 1)), codes), codes[other]

    def _codes(self, text: str | None) -> np.ndarray:
        words, memo = words_of(text), self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(memo) > REMEMBERED:
                memo.clear()
            for w in words:
                if w not in memo:
                    found = self.rows.get(w)
                    memo[w] = key_of(w) if found is None else found
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


@dataclass
class WindowNetwork:
    embed: np.ndarray  # CLASSES + 1 and further words by DIM
    place: np.ndarray  # offsets by DIM
    out: np.ndarray  # DIM by CLASSES
    bias: np.ndarray  # CLASSES

    @staticmethod
    def start(share: np.ndarray, seed: int = 5, class_of: np.ndarray | None = None) -> "WindowNetwork":
        """share: relative frequency of each class; class_of: rows of further words start as their class's."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: ((rng.random(shape) - 0.5) / np.sqrt(DIM)).astype(np.float32)
        embed = draw(CLASSES + 1, DIM)
        return WindowNetwork(embed if class_of is None else embed[class_of], np.ones((len(OFFSETS), DIM), np.float32), draw(DIM, CLASSES), np.log(share + 1e-6).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.place.ravel(), self.out.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> "WindowNetwork":
        fixed = [(len(OFFSETS), DIM), (DIM, CLASSES), (CLASSES,)]
        shapes = [((len(flat) - sum(int(np.prod(s)) for s in fixed)) // DIM, DIM), *fixed]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return WindowNetwork(*(part.reshape(s).astype(np.float32) for part, s in zip(np.split(np.asarray(flat), cuts), shapes)))

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """context: rows by offsets."""
        hidden = (self.embed[context] * self.place).sum(1)
        z = hidden @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def exp_logits(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """exp of the logits less what the second result says; hidden: with a one behind each row, for the bias."""
        last = np.vstack([self.out, self.bias])
        z, top = product(hidden, last), 0.0
        # where no logit can overflow in exp, the maximum need not be taken off
        if np.einsum("ij,ij->i", hidden, hidden).max() * np.einsum("ij,ij->j", last, last).max() > 60**2:
            top = z.max(1)
            z -= top[:, None]
        return np.exp(z, out=z), top

    def log_likelihood(self, found: np.ndarray, rows: np.ndarray | None = None) -> float:
        """Sum over all places of a text's classes, each given the words around it (rows; without them, their classes)."""
        placed, total = self.embed * self.place[:, None, :] if rows is None else None, 0.0
        rows = found if rows is None else rows
        last = np.ascontiguousarray(np.vstack([self.out, self.bias]).T)
        padded = np.concatenate([np.full(SIDE, EDGE), rows, np.full(SIDE, EDGE)])
        for a in range(0, len(found), SCORED_AT_ONCE):
            target = found[a : a + SCORED_AT_ONCE]
            n = len(target)
            if placed is None:
                hidden = np.einsum("njd,jd->nd", self.embed.take(windows(rows, a, n), 0), self.place)
            else:
                hidden = placed[0].take(padded[a : a + n], 0)
                for j, d in enumerate(OFFSETS[1:], 1):
                    hidden += placed[j].take(padded[a + SIDE + d : a + SIDE + d + n], 0)
            hidden = with_one(hidden)
            z, top = self.exp_logits(hidden)
            own = np.einsum("nd,nd->n", hidden, last.take(target, 0)) - top
            total += float((own - np.log(product(z, ONES)[:, 0])).sum(dtype=np.float64))
        return total

    def lines(self) -> int:
        """Lines of DIM weights in ``flat``."""
        return len(self.embed) + len(OFFSETS) + CLASSES + CLASSES // DIM

    def gradient(self, context: np.ndarray, target: np.ndarray, total: np.ndarray, met: np.ndarray) -> None:
        """Adds the gradient of the negative log-likelihood of these places to total (lines by DIM, as in ``flat``), and what each embedding was met to met."""
        seen = self.embed.take(context, 0)
        hidden = with_one(np.einsum("njd,jd->nd", seen, self.place))
        z, _ = self.exp_logits(hidden)
        sums = product(z, ONES)
        z[np.arange(len(target)), target] -= sums[:, 0]  # the gradient of the logits, but for the division by sums
        back = product(z, self.out.T)
        back /= sums
        hidden /= sums
        last = product_over_rows(hidden, z)
        # sum of the changes of each embedding row; numbers of 16 bits are sorted by counting
        rows = context.ravel().astype(np.min_scalar_type(len(self.embed)))
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        change = (back[:, None, :] * self.place).reshape(-1, DIM)
        total[rows[starts]] += np.add.reduceat(change.take(order, 0), starts, 0)
        met[rows[starts]] += np.diff(np.append(starts, len(rows)))
        k = len(self.embed)
        total[k : k + len(OFFSETS)] += np.einsum("nd,njd->jd", back, seen)
        total[k + len(OFFSETS) :] += last.reshape(-1, DIM)


@dataclass
class Descent:
    """Steps of all weights by running means of their gradients and of its squares; lines by DIM."""

    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, network: WindowNetwork, total: np.ndarray, met: np.ndarray, places: int, rate: float) -> WindowNetwork:
        """total: gradient summed over all places; met: what each embedding was met. Embeddings seldom met move less."""
        weight = np.full(len(total), float(places))
        weight[: len(met)] = met + HALFWAY
        grad = total / weight[:, None]
        self.steps += 1
        self.first = MOMENTUM * self.first + (1 - MOMENTUM) * grad
        self.second = SPREAD * self.second + (1 - SPREAD) * grad * grad
        move = self.first / (1 - MOMENTUM**self.steps) / (np.sqrt(self.second / (1 - SPREAD**self.steps)) + 1e-5)
        move[: len(met)] *= (met / (met + HALFWAY))[:, None]
        return WindowNetwork.of(network.flat() - rate * move.ravel())


def windows(found: np.ndarray, start: int, n: int) -> np.ndarray:
    """Contexts of n places from ``start`` on."""
    around = found[max(0, start - SIDE) : start + n + SIDE]
    n = min(n, len(found) - start)
    padded = np.full(n + 2 * SIDE, EDGE)
    first = max(0, SIDE - start)
    padded[first : first + len(around)] = around
    return np.stack([padded[SIDE + d : SIDE + d + n] for d in OFFSETS], 1)


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; tasks add up before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def emit():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    counts.update(words_of(text))
                    if len(counts) > COUNTED_AT_ONCE:
                        yield emit()
        yield emit()

    return df.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def alphabet(df: DataFrame, text_col: str = "text") -> Alphabet:
    """Every word of the frame: classes, words with an embedding, and the counts of all others."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([key_of(w) for w in part.column(0).to_pylist()], pa.int64())], names=["word", "n", "key"])

    counts = written(count_words(df, text_col).mapInArrow(run, "word binary, n long, key long"))
    occurs = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.col("n").desc(), "word").limit(KNOWN + int(occurs**0.5)).select("word", "n", "key").collect()
    known = {bytes(r.word): i for i, r in enumerate(top[:KNOWN])}
    totals, distinct, own = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(KNOWN)
    own[: len(known)] = [r.n for r in top[:KNOWN]]
    for r in counts.groupBy(F.col("key").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        totals[r.b], distinct[r.b] = r.n, r.k
    for r in top[:KNOWN]:
        totals[bucket(bytes(r.word))] -= r.n
        distinct[bucket(bytes(r.word))] -= 1
    share = np.concatenate([own, totals]) + 0.5
    return Alphabet(known, {bytes(r.word): r.n for r in top[KNOWN:]}, totals, distinct, share / share.sum(), counts.groupBy("key").agg(F.sum("n").alias("n")))


def coded(df: DataFrame, words: Alphabet, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The kept columns, turn (the round that trains the text), codes (rows of its words as 32-bit numbers) and others (keys of words without a row)."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    names = [f"p{i}" for i in range(len(keep))]
    turn = F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)).cast("int")
    asked = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), turn.alias("turn"), F.col(text_col).alias("text"))
    schema = T.StructType([*asked.schema.fields[:-1], T.StructField("codes", T.BinaryType()), T.StructField("others", T.ArrayType(T.LongType()))])

    def run(batches):
        own, n = shared.value, len(schema) - 2
        for batch in batches:
            for part in slices(batch):
                found = [own.placed(t) for t in part.column(n).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for _, x in found])]).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(x for _, x in found)])))
                codes = pa.array([rows.astype(np.int32).tobytes() for rows, _ in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), codes, others], names=schema.names)

    # in order of the rounds, so that each reads its own pages only
    return asked.mapInArrow(run, schema).sortWithinPartitions("turn")


def _rows(codes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), np.int32) for c in codes]


def gradients(coded: DataFrame, words: Alphabet, network: WindowNetwork) -> DataFrame:
    """(i, met, g0, ...): sums over all places of the coded texts, by line of the weights; met of other lines than embeddings are the places."""
    shared = coded.sparkSession.sparkContext.broadcast((words.class_of, network.flat()))

    def run(batches):
        class_of, flat = shared.value
        net, k = WindowNetwork.of(flat), len(class_of)
        total, met, places = np.zeros((net.lines(), DIM)), np.zeros(k, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                edges = np.full(SIDE, EDGE, np.int32)
                rows = np.concatenate([edges, *(x for codes in _rows(part.column(0)) for x in (codes, edges))])
                at = np.flatnonzero(rows != EDGE)
                for a in range(0, len(at), SUMMED_AT_ONCE):
                    of = at[a : a + SUMMED_AT_ONCE]
                    net.gradient(rows[np.stack([of + d for d in OFFSETS], 1)], class_of[rows[of]], total, met)
                places += len(at)
        met = np.concatenate([met, np.full(len(total) - k, places)])
        moved = np.flatnonzero(met)
        for a in range(0, len(moved), SENT_AT_ONCE):
            part = moved[a : a + SENT_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(met[part]), *(pa.array(total[part, j]) for j in range(DIM))], names=["i", "met", *(f"g{j}" for j in range(DIM))])

    columns = [f"g{j}" for j in range(DIM)]
    sums = coded.select("codes").mapInArrow(run, "i long, met long, " + ", ".join(f"{c} double" for c in columns))
    return sums.groupBy("i").agg(F.sum("met").alias("met"), *(F.sum(c).alias(c) for c in columns))


def trained(table: DataFrame, words: Alphabet) -> WindowNetwork:
    """The network that all texts of a coded table give."""
    network, k = WindowNetwork.start(words.share, class_of=words.class_of), len(words.class_of)
    descent = Descent(np.zeros((network.lines(), DIM)), np.zeros((network.lines(), DIM)))
    for turn in range(ROUNDS):
        sums = gradients(table.where(F.col("turn") == turn), words, network).toArrow()
        if not sums.num_rows:
            continue
        i, met = sums.column("i").to_numpy(), sums.column("met").to_numpy()
        total, all_met = np.zeros((network.lines(), DIM)), np.zeros(network.lines())
        all_met[i] = met
        total[i] = np.stack([sums.column(f"g{j}").to_numpy() for j in range(DIM)], 1)
        if all_met[-1]:
            rate = RATE + (LAST_RATE - RATE) * turn / (ROUNDS - 1)
            network = descent.step(network, total, all_met[:k], int(all_met[-1]), rate)
    return network


def fit(df: DataFrame, text_col: str = "text") -> tuple[Alphabet, WindowNetwork]:
    """Learns from every text of the frame."""
    words = alphabet(df, text_col)
    with Scratch(df.sparkSession) as scratch:
        return words, trained(scratch(coded(df, words, text_col)), words)


def score_text(text: str | None, words: Alphabet, network: WindowNetwork) -> tuple[int, float]:
    """Number of words and the sum of their conditional log-probabilities, those without a row of their own as if they occurred once."""
    rows = words.placed(text)[0]
    return len(rows), _log_probability(rows, words, network)


def _log_probability(rows: np.ndarray, words: Alphabet, network: WindowNetwork) -> float:
    return network.log_likelihood(words.class_of[rows], rows) + float(words.of_row[rows].sum())


def _numbered(df: DataFrame, text_col: str, keep_text: bool) -> tuple[DataFrame, list[str]]:
    """The frame with numbered rows, and the columns to keep; the numbers' column is the last of both."""
    own = [df.columns[i] for i in passing(df, ["n_words", "log_prob", "mean_log_prob"])]
    row = "_" + max(df.columns, key=len)  # longer than any name there
    kept = [c for c in own if keep_text or c.lower() != text_col.lower()]
    return df.withColumn(row, F.monotonically_increasing_id()), [*kept, row]


def _scored_table(table: DataFrame, kept: list[str], words: Alphabet, network: WindowNetwork) -> DataFrame:
    """Scores the texts of a written ``coded`` table whose kept columns these are, row numbers last."""
    shared = table.sparkSession.sparkContext.broadcast((words, network.flat()))
    fields, n = table.schema.fields, len(kept)
    schema = T.StructType([*fields[:n], T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType())])

    def run(batches):
        own, flat = shared.value
        net = WindowNetwork.of(flat)
        for batch in batches:
            for part in slices(batch):
                found = _rows(part.column(n))
                sums = [_log_probability(x, own, net) for x in found]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array([len(x) for x in found], pa.int64()), pa.array(sums, pa.float64())], names=schema.names)

    row = f"p{n - 1}"
    out = table.select(*(f.name for f in fields[:n]), "codes").mapInArrow(run, schema)
    if words.counts is not None:
        # what a word occurs, for the words without a row; those that the corpus does not have share one occurrence
        absent = F.element_at(F.array(*(F.lit(-float(np.log(k + 1))) for k in words.distinct)), (F.col("key").bitwiseAND(BUCKETS - 1) + 1).cast("int"))
        others = table.select(row, F.explode("others").alias("key")).join(words.counts, "key", "left")
        more = others.groupBy(row).agg(F.sum(F.coalesce(F.log("n"), absent)).alias("more"))
        out = out.join(more, row, "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.col("log_prob") / F.nullif(F.col("n_words"), F.lit(0))
    return out.select(*(F.col(f"p{i}").alias(c) for i, c in enumerate(kept[:-1])), "n_words", "log_prob", mean.alias("mean_log_prob"))


def scored(df: DataFrame, words: Alphabet, network: WindowNetwork, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``n_words``, ``log_prob`` (the sum) and ``mean_log_prob``."""
    rows, kept = _numbered(df, text_col, keep_text)
    return _scored_table(written(coded(rows, words, text_col, kept)), kept, words, network)


def fit_scored(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``scored`` by the network that the frame's own texts train; every text is coded once."""
    words = alphabet(df, text_col)
    rows, kept = _numbered(df, text_col, keep_text)
    table = written(coded(rows, words, text_col, kept))
    return _scored_table(table, kept, words, trained(table, words))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network that all of them train."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fit_scored(docs, keep_text=False).select("doc_id", "n_words", "log_prob", "mean_log_prob")
