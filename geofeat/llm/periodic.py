"""Periodic runs of words, by maximal pairs from an LCP-interval tree.

A run is a stretch of words with smallest period q and exponent 3 or more which no
neighbouring word extends. Its start s and s + q are a maximal pair: the words from both
on agree over length - q words, then differ, and the words to their left differ. So runs
are read off the maximal pairs (i, j) of match length m with 2 * (j - i) <= m, and no
stretch has to be extended word by word.

For each text, in the task that reads it:

1. words become numbers, and a rolling hash finds the starts whose first ``LEAST``
   words occur again; a qualifying pair matches over so many words, so all other starts
   are out (``repeated_starts``; a collision only keeps a start too many);
2. these starts are sorted by names of 16, 32, 64 ... words (``suffix_order``) and
   neighbours get their match lengths (``match_lengths``); names are exact, not hashes;
3. the intervals of equal match length are visited from the bottom up with a stack. An
   interval keeps its starts in lists by the word to their left, in blocks about as wide
   as half its match length. When two intervals meet, each start of the smaller one asks
   the lists of the other left words in its own block and the two beside it
   (``IntervalLists``). Starts so close to each other overlap and have, but for the
   first of a chain, one left word, so a block has few lists, and moving the smaller
   side makes the work n log n steps of a binary search.

The same stretch also gives pairs at multiples of its period; of equal stretches the
smallest period stays.

Nothing is shuffled and nothing is broadcast. A task holds one Arrow slice and the
arrays of one text at a time, whose size is a multiple of that text's.

Cases: null and empty texts, and texts of fewer words than ``MIN_LENGTH``, have no runs; texts of any
length are taken whole; runs that tie for the best go to the smaller start, then the
smaller period; repeated rows are judged alike; a null doc_id counts as a text that is
not rewritten; extra columns pass through, and those with an output's name are replaced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.common import passing, place, read, slices

#: Words of a run, and periods in it, at least.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: A qualifying pair matches over this many words at least: length - q with length >= max(24, 3 q).
LEAST = MIN_LENGTH - MIN_LENGTH // MIN_PERIODS


@dataclass(frozen=True, order=True)
class Run:
    start: int
    period: int
    length: int


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, by first occurrence."""
    known = dict.fromkeys(words)
    known = dict(zip(known, range(len(known))))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``LEAST`` words from each start on."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        base, k = np.uint64(0xD6E8FEB86659FD93), 1
        while k < LEAST:
            h = h[: len(h) - k] * base + h[k:]
            base, k = base * base, 2 * k
    return h


def repeated_starts(ids: np.ndarray) -> np.ndarray:
    """Starts, in order, whose first ``LEAST`` words occur at another start too."""
    grams = _grams(ids)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs, equal where the pairs are, in the order of ``a``, then ``b`` (-1 at least)."""
    return np.unique(a * (b.max() + 2) + (b + 1), return_inverse=True)[1]


def suffix_order(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The starts in the order of what follows them to the end of the text, word by word.

    Names of twice as many words are made of two names, until all differ. Starts which
    agree over 2 ``LEAST`` words or more are ``LEAST`` words later starts as well, so the
    names of ``starts`` and of the places ``LEAST`` words behind them are all it takes.
    """
    n = len(ids)
    named = np.union1d(starts, starts[starts + LEAST < n] + LEAST)
    wide = np.zeros(n + LEAST, bool)
    for k in range(LEAST):
        wide[named + k] = True
    near = np.flatnonzero(wide[:n])
    at = np.full(n + LEAST, -1, np.int64)
    at[near] = np.arange(len(near))
    name, k = ids[near], 1
    while k < LEAST:  # names that reach beyond ``near`` belong to none of ``named``; -1 is the end of the text
        other = at[near + k]
        name = _names(name, np.where(other >= 0, name[other], -1))
        k *= 2
    name = np.unique(name[at[named]], return_inverse=True)[1]
    at = np.full(n + 1, -1, np.int64)
    at[named] = np.arange(len(named))
    while name.max() + 1 < len(name):
        other = at[np.minimum(named + k, n)]
        name = _names(name, np.where(other >= 0, name[other], -1))
        k *= 2
    return starts[np.argsort(name[at[starts]])]


def match_lengths(ids: list[int], order: list[int]) -> list[int]:
    """For each start in order, over how many words it agrees with the one before; 0 for the first, and less than ``LEAST`` means no more than that."""
    n, place_of, out = len(ids), {s: k for k, s in enumerate(order)}, [0] * len(order)
    h, last = 0, -2
    for s in sorted(order):
        k = place_of[s]
        # one word less than the start before it, as long as that leaves enough for the partner to be a start
        h = h - 1 if s == last + 1 and h > LEAST else 0
        last = s
        if not k:
            h = 0
            continue
        t = order[k - 1]
        end = n - max(s, t)
        while h < end and ids[s + h] == ids[t + h]:
            h += 1
        out[k] = h
    return out


class IntervalLists:
    """Starts of one LCP interval: sorted lists by left word, in blocks of ``width`` positions."""

    __slots__ = ("blocks", "size", "width")

    def __init__(self, start: int, left: int, width: int):
        self.blocks, self.size, self.width = {start // width: {left: [start]}}, 1, width

    def items(self):
        return [(left, starts) for lists in self.blocks.values() for left, starts in lists.items()]

    def narrow(self, width: int) -> None:
        """Deals the starts into blocks of another width."""
        if width == self.width:
            return
        held, self.blocks, self.width = self.items(), {}, width
        if self.size == 1:
            [(left, [start])] = held
            self.blocks[start // width] = {left: [start]}
            return
        for left, starts in held:
            for s in starts:
                self.blocks.setdefault(s // width, {}).setdefault(left, []).append(s)
        for lists in self.blocks.values():
            for starts in lists.values():
                starts.sort()

    def add(self, left: int, starts: list[int]) -> None:
        for s in starts:
            insort(self.blocks.setdefault(s // self.width, {}).setdefault(left, []), s)
        self.size += len(starts)

    def beside(self, start: int, left: int):
        """The nearest starts on both sides in every list of another left word, out of the blocks around ``start``."""
        b = start // self.width
        for lists in (self.blocks.get(b - 1), self.blocks.get(b), self.blocks.get(b + 1)):
            for other, starts in lists.items() if lists else ():
                if other != left:
                    k = bisect_left(starts, start)
                    if k:
                        yield starts[k - 1]
                    if k < len(starts):
                        yield starts[k]


def width_of(match: int) -> int:
    """The block width of an interval: the power of two from half its match length on."""
    return 1 << max(match // 2 - 1, 0).bit_length()


def maximal_pairs(ids: list[int], order: list[int], matches: list[int]):
    """(i, j, match length) of the maximal pairs with 2 * (j - i) <= match length and a stretch of ``MIN_LENGTH`` words, i < j.

    Of the pairs of two lists the closest to each start are given; farther ones of the
    same interval lie at multiples of the period of a stretch.
    """

    def meet(a: IntervalLists, b: IntervalLists, match: int):
        """One interval out of two, and the pairs between them."""
        if a.size < b.size:
            a, b = b, a
        a.narrow(width_of(match))
        reach, moved = match // 2, b.items()
        for left, starts in moved:
            for s in starts:
                for t in a.beside(s, left):
                    if abs(t - s) <= reach and abs(t - s) + match >= MIN_LENGTH:
                        found.append((min(s, t), max(s, t), match))
        for left, starts in moved:
            a.add(left, starts)
        return a

    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, IntervalLists]] = []  # open intervals: match length with what follows, starts so far
    for k, start in enumerate(order):
        held = IntervalLists(start, ids[start - 1] if start else -1, 1)
        # the match with the next start tells to which interval this one belongs
        ahead = matches[k + 1] if k + 1 < len(order) else 0
        # open intervals that match over more words than what follows are complete; each ends in the one below it
        while stack and stack[-1][0] > ahead:
            match, below = stack.pop()
            held = meet(below, held, match)
        if ahead >= LEAST:
            if stack and stack[-1][0] == ahead:
                held = meet(stack.pop()[1], held, ahead)
            stack.append((ahead, held))
        yield from found
        found.clear()


def runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of numbers, by start, then period."""
    if len(ids) < MIN_LENGTH:
        return []
    starts = repeated_starts(ids)
    if not len(starts):
        return []
    order, plain = suffix_order(ids, starts).tolist(), ids.tolist()
    best: dict[tuple[int, int], int] = {}
    for i, j, match in maximal_pairs(plain, order, match_lengths(plain, order)):
        stretch = (i, j - i + match)
        best[stretch] = min(best.get(stretch, j - i), j - i)
    return sorted(Run(s, q, length) for (s, length), q in best.items())


def best_run(found: list[Run]) -> Run | None:
    """The run of the greatest exact exponent; ties go to the smaller start, then the smaller period."""
    return min(found, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay when every run keeps its first period alone, unless another run drops those words too."""
    steps = np.zeros(n + 1, np.int64)
    for r in found:
        steps[r.start + r.period] += 1
        steps[r.start + r.length] -= 1
    return np.cumsum(steps[:n]) == 0


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of ``n`` words that is made periodic; null for one that is not."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


#: What the operator adds to a row.
OUT = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("collapsed", T.BinaryType()),
    ]
)


def periodic_runs(df: DataFrame, text_col: str = "text", rewrite_by: str | None = None) -> DataFrame:
    """Adds the runs of each whole text, the best of them, and the text with each run cut to one period (words joined by a space, as bytes).

    ``rewrite_by`` names an id column by which some texts are first made periodic, as
    ``rewritten`` says.
    """
    at, kept = place(df, text_col), passing(df, OUT.names)
    by = place(df, rewrite_by) if rewrite_by else None
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *OUT.fields])
    kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.binary()]

    def one(text: bytes | None, doc_id: int | None) -> tuple:
        words = text.split() if text else []
        n = len(words)
        ids = numbered(words)
        source = rewritten(doc_id, n)
        if source is not None:
            ids, words = ids[source], [words[k] for k in source.tolist()]
        found = runs(ids)
        best = best_run(found)
        if found:
            words = [words[k] for k in np.flatnonzero(kept_words(n, found)).tolist()]
        shown = (best.start, best.length, best.period, 1_000 * best.length // best.period) if best else (None,) * 4
        return n, len(found), *shown, [{"start": r.start, "length": r.length, "period": r.period} for r in found], b" ".join(words)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                ids = part.column(by).to_pylist() if by is not None else [None] * len(texts)
                rows = [one(t, i) for t, i in zip(texts, ids)]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *made], names=schema.names)

    return df.mapInArrow(run, schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which a tenth is made periodic by its id first."""
    found = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), rewrite_by="doc_id")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
