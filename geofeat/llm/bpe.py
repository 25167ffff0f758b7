"""Byte-level BPE encoding and decoding.

A text is split by a pattern into pre-tokens; each is merged on its own, lowest
rank first and leftmost among equal ranks. The pairs of a pre-token wait in a
rank queue: one bucket of linked-list positions per merge rank, and over the
buckets a hierarchy of bitmaps in which find-first-set gives the next rank.
Entries that a merge has made stale are skipped when they come up, so a
pre-token of n bytes takes O(n) queue steps however long it is.

Spark only moves the texts: every document is encoded in the task that reads
it, with no shuffle. The rank table (below 1 MB) is the only broadcast.

Cases: a null text has a null id list, an empty text an empty one; a null id list
decodes to null; ids outside the vocabulary raise ValueError. Extra columns pass
through; a column which already has the output's name is replaced.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.common import passing, place, read, slices

#: Pre-tokens up to this many characters are remembered, at most so many of them.
CACHED_CHARS, CACHED_TOKENS = 48, 250_000
#: The same where nothing else needs the memory of the workers, so that it may outlive a task.
KEPT_TOKENS = 400_000
#: A bitmap word spans 2 ** BITS ranks.
BITS = 8
MASK = (1 << BITS) - 1
BIT = [1 << i for i in range(4_096)]


class Pieces(dict):
    """Pre-token to its ids as packed 32-bit integers; short ones are remembered, in a younger and an older generation."""

    def __init__(self, own: Codec):
        super().__init__()
        self.own, self.old, self.most = own, {}, CACHED_TOKENS

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            packed = self.own.packed
            found = b"".join([packed[i] for i in self.own.merge(text.encode("utf-8", "surrogatepass"))])
        if len(text) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        if max(self.tokens) >> BITS >= len(BIT):
            raise ValueError(f"ranks go up to {len(BIT) << BITS}")
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        ``buckets`` holds the positions that wait under a rank, ``low`` the bitmap
        words over the ranks and ``top`` the bitmap over those words.
        """
        rank_of, longest = self.ranks.get, self.longest
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # of a live node: where the next one starts
        before = list(range(-1, n - 1))
        waiting: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # rank under which a node's pair waits; other entries are stale
        waiting.append(None)
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for i, rank in enumerate(waiting):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> BITS
                    if word in low:
                        low[word] |= BIT[rank & MASK]
                    else:
                        low[word] = BIT[rank & MASK]
                        top |= BIT[word]
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                bits &= bits - 1
                if bits:
                    low[word] = bits
                else:
                    del low[word]
                    top &= top - 1
            if waiting[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            waiting[i] = waiting[j] = None
            if k < n:
                before[k] = i
                right = after[k]
                rank = rank_of(piece[i:right]) if right - i <= longest else None
                if rank is not None:
                    waiting[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> BITS
                        if word in low:
                            low[word] |= BIT[rank & MASK]
                        else:
                            low[word] = BIT[rank & MASK]
                            top |= BIT[word]
            h = before[i]
            if h >= 0:
                rank = waiting[h] = rank_of(piece[h:k]) if k - h <= longest else None
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], h)
                    else:
                        buckets[rank] = [h]
                        word = rank >> BITS
                        if word in low:
                            low[word] |= BIT[rank & MASK]
                        else:
                            low[word] = BIT[rank & MASK]
                            top |= BIT[word]
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def forget(self) -> None:
        """Frees what is remembered of pre-tokens; workers live longer than their tasks."""
        self.pieces.clear()
        self.pieces.old = {}

    def remember(self, most: int) -> None:
        """How many pre-tokens a generation may hold from now on."""
        self.pieces.most = most

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))), np.int32)

    def decode(self, ids) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"id {e.args[0]} is not in the vocabulary") from None


_CODECS: dict[tuple[int, int, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of these ranks, one for each Python worker."""
    key = (len(data), hash(data), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def load_ranks(path: str) -> bytes:
    """Contents of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: bool = False) -> DataFrame:
    """Adds the token ids of ``text_col`` as ``array<int>``; with ``decoded_col`` also the bytes that the ids decode to.

    Pre-tokens are forgotten when a task ends, as stages after this one may need the memory. With ``keep`` a
    worker's next task finds those of the tasks before, two generations of ``KEPT_TOKENS`` at most.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at, kept = place(df, text_col), passing(df, [c for c in (ids_col, decoded_col) if c])
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col or "", T.BinaryType())]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *new[: 1 + bool(decoded_col)]])

    def run(batches):
        own = codec(shared.value, pattern)
        own.remember(KEPT_TOKENS if keep else CACHED_TOKENS)
        for batch in batches:
            for part in slices(batch):
                found = [None if t is None else own.encode(t) for t in part.column(at).to_pylist()]
                columns = [*(part.column(i) for i in kept), _lists(found)]
                if decoded_col:
                    columns.append(pa.array([None if ids is None else own.decode(ids.tolist()) for ids in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if not keep:
            own.forget()

    return df.mapInArrow(run, schema)


def _lists(found: list) -> pa.Array:
    sizes = np.fromiter((0 if x is None else len(x) for x in found), np.int64, len(found))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *(x for x in found if x is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([x is None for x in found]))


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes which the ids in ``ids_col`` stand for, as ``binary``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at, kept = place(df, ids_col), passing(df, [out_col])
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out_col, T.BinaryType())])

    def run(batches):
        own = codec(shared.value, "")
        for batch in batches:
            for part in slices(batch):
                found = [None if ids is None else own.decode(ids) for ids in _each(part.column(at))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(found, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def _each(lists: pa.ListArray):
    """The rows of a list column as Python lists, from one flat array."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for i, valid in enumerate(lists.is_valid().to_pylist()):
        yield flat[ends[i] : ends[i + 1]].tolist() if valid else None


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: ids and bytes as digests."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded", keep=True).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
