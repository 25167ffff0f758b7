r"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

Base spans, leftmost and non-overlapping for each kind, as code point offsets:

- ``assign``: a credential word, an assignment sign and a value of 6 characters or more;
- ``access``: an access key id, ``AKIA`` and capitals or digits, 20 characters or more;
- ``hex``: a run of 24 lower-case hexadecimal digits or more.

On top of them, ``novel`` spans: a run of 16 or more key characters, holding both
letters and digits, which stands up to 48 characters behind a word of sensitive
context and overlaps no base span. Its novelty is the marginal size of the run: the
zstandard-compressed size of the code around it with the run, less that without
it, under a dictionary primed with common identifiers. English, identifiers and
repetition compress; random keys do not. A run is reported when its marginal
bytes reach ``NOVELTY`` of its length.

Every document is scanned whole, in the task which reads it: no shuffle, nothing
but constants is sent out. Cases: a null text has null spans in the operator and
counts as empty in the query; an empty text has none; extra columns pass through,
and one that has the output's name is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.common import passing, place, read, slices

# The base patterns, their kinds in order, and the words around secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"auth|bearer|credential|passphrase|private|signature|secret|token|passw|api.?key|access.?key|client.?id|cookie|session|pwd|ssh-", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIERS = """
import export return function class public private static const default require config settings environment variable
username user_name password passwd secret token api_key apikey access_key access_token refresh_token client_id client_secret
authorization bearer basic session cookie credentials private_key public_key ssh-rsa ssh-ed25519 signature certificate
localhost example.com http:// https:// database connection string host port timeout retry request response header body
self.assertEqual os.environ getenv process.env System.getenv json yaml true false null None undefined
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 123456789 1111111111 0000000000 xxxxxxxxxxxx
the quick brown fox jumps over the lazy dog placeholder changeme your_token_here your-api-key sample test dummy
"""
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
SENSITIVE_WORDS = (b"auth", b"bearer", b"credential", b"passphrase", b"private", b"signature", b"secret", b"token", b"passw", b"api", b"access", b"client", b"cookie", b"session", b"pwd", b"ssh-")
BEFORE, AFTER, NEAR, NOVELTY = 96, 48, 48, 0.75
#: Hexadecimal digits to 1, all other bytes to 0.
IS_HEX = bytes(chr(i) in "0123456789abcdef" for i in range(256))
LONG_HEX = b"\1" * 24

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)


class Novelty:
    """Marginal compressed bytes of a string among the text around it."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)

    def size(self, text: str) -> int:
        return len(self.zstd.compress(text.encode("utf-8", "surrogatepass")))

    def ratio(self, before: str, run: str, after: str) -> float:
        return (self.size(before + run + after) - self.size(before + after)) / len(run)


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted; raw and low: the text's bytes, and those in lower case.

    Substring searches in the bytes tell which patterns can match at all.
    """
    found = []
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if LONG_HEX in raw.translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, int]]:
    """Base spans and novel ones, sorted by start, then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = base_spans(text, raw, low)
    if not any(word in low for word in SENSITIVE_WORDS):
        return found
    starts, ends = [a for a, *_ in found], list(accumulate((b for *_, b in found), max))  # of base spans up to each
    end_of_last, known = -1, {}
    for context in SENSITIVE.finditer(text):
        if context.start() < end_of_last:
            continue
        for m in RUN.finditer(text, context.start(), context.end() + NEAR + 256):
            a, b = m.span()
            if a > context.end() + NEAR:
                break
            run = m[0]
            before = bisect_left(starts, b)  # base spans that begin before the run ends
            if a < end_of_last or before and ends[before - 1] > a:
                continue
            if b == context.end() + NEAR + 256:  # the window cut it: take the whole run
                b = RUN.match(text, a).end()
                run = text[a:b]
            if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
                continue
            if (a, b) not in known:  # several context words may stand before one run
                known[a, b] = novelty.ratio(text[max(0, a - BEFORE) : a], run, text[b : b + AFTER])
            if known[a, b] >= NOVELTY:
                found.append((a, 3, b))
                end_of_last = b
    found.sort()
    return found


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """Adds the spans of secrets as an array of (kind, start, end), sorted by start, then kind."""
    at, kept = place(df, text_col), passing(df, [out_col])
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out_col, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            for part in slices(batch):
                found = [None if t is None else [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t, novelty)] for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(found, kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces every secret of ``text_col`` by ``mark``; overlapping spans by one mark."""
    at, schema = place(df, text_col), df.schema

    def clean(text: str | None, novelty: Novelty) -> str | None:
        if text is None or not (found := scan(text, novelty)):
            return text
        out, done = [], 0
        for a, _, b in found:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            for part in slices(batch):
                columns = list(part.columns)
                columns[at] = pa.array([clean(t, novelty) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with counts and a digest of the base ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_secrets(docs).drop("text")
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("secrets", lambda x: x["kind"] != "novel"), told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", told), ",").alias("spans"),
        count("novel").alias("n_novel"),
    )
