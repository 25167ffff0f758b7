"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

A rule names a host, with all its subdomains, and the beginning of a path; the
longest that fits decides. URLs which no rule decides are judged by
gradient-boosted trees trained from the URLs which the rules label: length, depth,
digit ratio, entropy, parameter counts, and how often the suffixes of the host and
the endings of the path were blocked or seen among all of them.

Splitting and rules are column expressions; the rule list is a parameter of a few
hundred entries at most, written into the plan. A Spark aggregation counts the
suffixes of all URLs; the trees learn from a bounded sample of the labelled ones
(``SAMPLE`` distinct URLs with the smallest hashes). Scoring runs in the tasks
which read the URLs. The counts of the most frequent suffixes go to all of them; URLs
that have others are joined with the counts of those. A URL that comes often has frequent suffixes
only, so no key of that join is common.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged by the trees on empty features; if the rules label no URL, or label
all alike, the verdict of the rest is the only one seen, or ``allow``; extra columns
pass through, and those with an output's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofeat.llm.boosting import BoostedTrees
from geofeat.llm.common import passing, place, read, slices, written

#: Distinct URLs that the trees may learn from, at most; suffixes are counted over all.
SAMPLE = 20_000
#: Suffixes whose counts every task holds; those of all others are joined.
SUFFIXES = 4_000
PARTS, COUNTED_AT_ONCE = 1_000_000_007, 100_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query, longest match wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path, and what follows them."""
    if not url or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    a = min(ends, default=len(rest))
    stops = [i for i in (rest.find(c, a) for c in "?#") if i >= 0]
    b = min(stops, default=len(rest))
    return rest[:a].lower(), rest[a:b], rest[b:]


def suffixes(host: str, path: str) -> list[str]:
    """Names whose share of blocked URLs is a feature: the host's last label, its last two, the path's first step, its ending."""
    labels, steps = host.split("."), path.split("/")
    ending = steps[-1].rpartition(".")[2] if "." in steps[-1] else ""
    return ["." + labels[-1], "." + ".".join(labels[-2:]), "/" + (steps[1] if len(steps) > 1 else ""), "end:" + ending]


@dataclass
class UrlModel:
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    share: float = 0.0
    n: int = 0
    trees: BoostedTrees | None = None

    def features(self, url: str | None, more: dict[str, tuple[float, float]] | None = None) -> list[float]:
        """``more``: counts of suffixes which are not among ``rates``."""
        host, path, rest = split_url(url)
        text = url or ""
        n = max(len(text), 1)
        entropy = -sum(c / n * log2(c / n) for c in Counter(text).values())
        digits = sum(c.isdigit() for c in text)
        out = [
            len(text), len(host), len(path), host.count("."), path.count("/"), digits / n, entropy, sum(c.isdigit() for c in host), text.count("-"), host.count("-"),
            rest.count("=") + rest.count("&"), float(rest[:1] == "?"), float("#" in rest), float(text[:8].lower() == "https://"), float(path[-1:] == "/"), float(host[:4] == "www."),
        ]
        for s in suffixes(host, path):
            blocked, seen = self.rates.get(s) or (more or {}).get(s, (0.0, 0.0))
            out += [(blocked + 4 * self.share) / (seen + 4), seen / max(self.n, 1)]
        return out

    def score(self, urls: list[str | None], more: list[dict[str, tuple[float, float]]] | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(urls), self.share)
        x = np.array([self.features(u, m) for u, m in zip(urls, more or [None] * len(urls))], float).reshape(len(urls), -1)
        return 1 / (1 + np.exp(-self.trees.margin(x)))


def fit(labelled: DataFrame, limit: int = SAMPLE) -> UrlModel:
    """labelled: url, blocked (0 or 1)."""
    return fitted(labelled, limit)[0]


def fitted(urls: DataFrame, limit: int) -> tuple[UrlModel, DataFrame | None]:
    """The model, and the counts (suffix, blocked, seen) of the suffixes that it does not hold itself, or None if it holds all.

    urls: url, blocked (0 or 1, null where no rule decides).
    """
    labelled = urls.where("blocked IS NOT NULL")
    total = labelled.agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).first()
    halves = counted(urls)
    model = UrlModel(frequent(halves), (total.blocked or 0) / max(total.n, 1), total.n)
    if 0 < model.share < 1:
        n = halves.agg(F.sum(F.when(F.col("suffix").isNull() & (F.col("half") == 0), F.col("seen"))).alias("n")).first().n or 0
        rows = sample(labelled, limit)
        rates = counts_of(halves, {s for url, _ in rows for s in suffixes(*split_url(url)[:2])})
        others = UrlModel(rates[1], model.share, total.n - n), UrlModel(rates[0], model.share, n)  # each half sees the suffix counts of the other
        x = [others[half_of(url)].features(url) for url, _ in rows]
        model.trees = BoostedTrees(n_trees=40, depth=3).fit(np.array(x, float), np.array([y for _, y in rows], float))
    if model.trees is None or len(model.rates) < SUFFIXES:
        return model, None
    held = urls.sparkSession.createDataFrame([(s,) for s in model.rates], "suffix string")
    return model, added(halves.where("seen > 0").join(F.broadcast(held), "suffix", "left_anti"))


def half_of(url: str | None) -> int:
    return xxhash.xxh3_64_intdigest((url or "").encode("utf-8", "surrogatepass")) & 1


def sample(labelled: DataFrame, limit: int) -> list[tuple[str, int]]:
    """The ``limit`` distinct URLs with the smallest hashes, or all; any order and partitioning of the rows gives the same."""
    hashed = labelled.select(F.coalesce("url", F.lit("")).alias("url"), "blocked", F.xxhash64(F.coalesce("url", F.lit(""))).alias("h"))
    n = hashed.select("h").distinct().count()
    near = F.pmod("h", F.lit(PARTS)) * F.lit(n) < F.lit(float(PARTS)) * (limit + 8 * limit**0.5 + 50)
    rows = hashed.where(near).distinct().orderBy(F.pmod("h", F.lit(PARTS)), "h", "url", "blocked").limit(limit).collect()
    return sorted((r.url, int(r.blocked)) for r in rows)


def counted(urls: DataFrame) -> DataFrame:
    """(suffix, half, seen, blocked, rows) of all URLs: labelled ones, blocked ones and any; and their number in each half with a null suffix. Tasks add up before the shuffle."""

    def run(batches):
        seen, blocked, rows = Counter(), Counter(), Counter()

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.int32()), *[pa.array([c[k] for k in rows], pa.int64()) for c in (seen, blocked, rows)]], names=["suffix", "half", "seen", "blocked", "rows"])
            for c in (seen, blocked, rows):
                c.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for url, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    half = half_of(url)
                    for s in [None, *suffixes(*split_url(url)[:2])]:
                        rows[s, half] += 1
                        if y is not None:
                            seen[s, half] += 1
                            blocked[s, half] += y
                    if len(rows) > COUNTED_AT_ONCE:
                        yield emit()
        yield emit()

    tasks = urls.select("url", "blocked").mapInArrow(run, "suffix string, half int, seen long, blocked long, rows long")
    return written(tasks.groupBy("suffix", "half").agg(*[F.sum(c).alias(c) for c in ("seen", "blocked", "rows")]))


def added(halves: DataFrame) -> DataFrame:
    """(suffix, blocked, seen, rows) of both halves."""
    return halves.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(*[F.sum(c).alias(c) for c in ("blocked", "seen", "rows")])


def frequent(halves: DataFrame) -> dict[str, tuple[float, float]]:
    """Blocked and labelled URLs of the ``SUFFIXES`` suffixes that most URLs have."""
    return {r.suffix: (float(r.blocked), float(r.seen)) for r in added(halves).orderBy(F.col("rows").desc(), "suffix").limit(SUFFIXES).collect()}


def counts_of(halves: DataFrame, names: set[str]) -> list[dict[str, tuple[float, float]]]:
    """Blocked and labelled URLs of the given suffixes, in each half."""
    asked = halves.sparkSession.createDataFrame([(s,) for s in sorted(names)], "suffix string")
    out = [{}, {}]
    for r in halves.where("seen > 0").join(F.broadcast(asked), "suffix").select("suffix", "half", "blocked", "seen").collect():
        out[r.half][r.suffix] = (float(r.blocked), float(r.seen))
    return out


def asking(rows: DataFrame, url: str, shared) -> DataFrame:
    """Adds the suffixes of each URL whose counts the model (a broadcast) does not hold, as ``url``_asked."""
    at = place(rows, url)
    schema = T.StructType([*rows.schema.fields, T.StructField(f"{url}_asked", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                names = [sorted({s for s in suffixes(*split_url(u)[:2]) if s not in shared.value.rates}) for u in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def judge(df: DataFrame, rules=RULES, url_col: str = "url", limit: int = SAMPLE) -> DataFrame:
    """Adds host, path, rule, verdict and score (the trees' probability of a block)."""
    url = "_" + max(df.columns, key=len)  # longer than any name there
    kept = [df.columns[i] for i in passing(df, ["host", "path", "rule", "verdict", "score"])]
    split = df.select(*kept, F.col(url_col).alias(url), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "verdict": action})
    model, others = fitted(ruled.select(F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("blocked")), limit)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at, width = place(ruled, url), len(ruled.columns)
    schema = T.StructType([*ruled.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                more = [{x["suffix"]: (x["blocked"], x["seen"]) for x in own or ()} for own in part.column(width).to_pylist()] if part.num_columns > width else None
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(shared.value.score(part.column(at).to_pylist(), more), pa.float64())], names=schema.names)

    if others is None:
        scored = ruled.mapInArrow(run, schema)
    else:
        asked = asking(ruled, url, shared)
        rare, names = asked.where(F.size(f"{url}_asked") > 0), F.col(f"{url}_asked")
        key = F.coalesce(F.col(url), F.lit("")).alias(f"{url}_key")
        pairs = rare.select(key, F.explode(names).alias("suffix")).distinct().join(others, "suffix")
        found = pairs.groupBy(f"{url}_key").agg(F.collect_list(F.struct("suffix", F.col("blocked").cast("double").alias("blocked"), F.col("seen").cast("double").alias("seen"))).alias(f"{url}_rates"))
        rated = rare.drop(f"{url}_asked").withColumn(f"{url}_key", key).join(found, f"{url}_key", "left").select(*ruled.columns, f"{url}_rates")
        scored = asked.where(F.size(names) == 0).select(*ruled.columns).mapInArrow(run, schema).unionByName(rated.mapInArrow(run, schema))
    scored = scored.drop(url)
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
