"""N-gram Jaccard join through a token-group matrix.

A document's set is its distinct five-word shingles (A-Z made small). Two documents
link when they share at least ``NUM / DEN`` of their union; the result is every
document's connected component. It is exact (but for collisions of 64-bit hashes):

1. Documents of equal sets become one representative.
2. Representatives are put into groups: those that agree on a band of minhashes are
   compared with a few of the band's most central members, the ones whose bands are
   the fullest, and verified links are joined up. A group is connected already, so
   nothing inside it is compared again; thousands of near copies cost a comparison
   or two each.
3. A link to another group needs shingles that other groups have. With the shingles
   of each set in hash order, the first ``SHARE`` of them are its prefix; if two sets
   of at most n shingles link, their prefixes have at least ``(SHARE - 1/4) * n`` in
   common. Documents with fewer shingles of other groups there are done. The others'
   whole sets are counted in the same way: ``need``, three quarters, must stand in
   other groups.
4. The token-group matrix: the shingles of what is left are ordered by how many
   groups have them, the rarest first. A group's token union is that of its members'
   shingles up to the last ``need - 1``. What a document shares with a partner is at
   most its overlap with the union of the partner's group and those last ones, so
   only groups with an overlap are opened. Of two groups, the documents of the
   smaller one ask.
5. Shingles of more than ``MANY`` groups (common lines, families of texts that are
   alike but do not link) would open groups one by one. Documents that have such ones
   before the last ``need - 1`` are put into groups by the rarest of these, and ask
   those groups: any two that share one there meet in one of them.

Members of small groups are compared pair by pair; large groups in blocks of about
``BLOCK_SHINGLES`` shingles against ``BLOCK_SHINGLES`` shingles, which return links that connect what
links in the block. Work moves as rows of (shingle, document) dealt by shingle; no list
of a shingle's documents, group or component is gathered in one row or task, and
nothing goes to the driver but counts. Written intermediate tables cut the lineage.

Cases: null and blank texts have the empty set, no links and themselves as
component; fewer than five words are one shingle; rows that share an id are one
document for links and keep their own size; a null id has no component; repeated
rows stay; very long texts are taken whole; other columns are left out of the result;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geofeat.llm.common import read, slices, written
from geofeat.llm.graph import components
from geofeat.sources.shared import Scratch

WORDS, NUM, DEN = 5, 75, 100
#: Part of a set, in hash order, that tells which documents can link at all.
SHARE = 0.4
#: Groups that a shingle opens one by one, at most; beyond, documents meet in the groups of their rarest common shingle.
MANY = 64
BANDS, ROWS = 8, 2
#: Central members that a band's others are compared with, in so many rounds; the best few are tried, if enough minhashes agree.
LEADERS, ROUNDS, TRIED, AGREE = 8, 2, 2, 9
#: Larger groups are compared in blocks of so many shingles on either side.
SMALL_GROUP, BLOCK_SHINGLES = 16, 150_000
#: Shingles which so many of a sample of documents have are known to be shared: at most a 20th of the sample's; they are sent to all tasks, so that their rows need not meet to find it out.
KNOWN_SAMPLE, KNOWN_SEEN = 2_000, 20
#: A digest with more than this part of all rows is hot; there are fewer than 200 such.
HOT = 0.005
#: A frame of ids is sent to all tasks while it is counted to be at most this long.
BROADCAST_ROWS = 500_000

_RANDOM = np.random.default_rng(2_024)
PLACES = _RANDOM.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
MINHASH = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = h[:n] * PLACES[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * PLACES[i]
    return np.unique(_mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Minhashes of a set."""
    return (found[None, :] * MINHASH[:, None]).min(1)


def bands(minhashes: np.ndarray) -> list[int]:
    """Keys which similar sets are likely to share."""
    least = minhashes.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key ^ least[:, j])
    return key.view(np.int64).tolist()


def prefix(found: np.ndarray, share: float) -> np.ndarray:
    return found[: int(np.ceil(share * len(found)))]


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n, digest, marks (minhashes), bands."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                marks = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(map(digest, sets), pa.binary()),
                        pa.array([[] if m is None else (m >> np.uint64(32)).astype(np.uint32).view(np.int32) for m in marks], pa.list_(pa.int32())),
                        pa.array([[] if m is None else bands(m) for m in marks], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "digest", "marks", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, marks array<int>, bands array<long>")


def _prefixes(docs: DataFrame, hot: dict[bytes, int]) -> DataFrame:
    """(token, rep): the prefixes of all sets; hot: digests of many copies, of which the representative alone counts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, sets = part.column(0).to_pylist(), [shingles(t) for t in part.column(1).to_pylist()]
                if hot:
                    sets = [s if hot.get(digest(s), i) == i else s[:0] for i, s in zip(ids, sets)]
                heads = [prefix(s, SHARE) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *heads]).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(h) for h in heads]))], names=["token", "rep"])

    return docs.where("doc_id is not null").mapInArrow(run, "token long, rep long")


def _bounded(ids: DataFrame) -> DataFrame:
    """Marks a frame of ids for broadcast while it is counted to be at most BROADCAST_ROWS long."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (doc_id and other columns of long) -> the same with the sorted shingles as bytes in ``found``."""
    others = [c for c in ids.columns if c != "doc_id"]
    wanted = docs.join(_bounded(ids), "doc_id").select("doc_id", *others, "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                *kept, texts = part.columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array([shingles(t).tobytes() for t in texts.to_pylist()], pa.binary())], names=["doc_id", *others, "found"])

    return wanted.mapInArrow(run, "".join(f"{c} long, " for c in ["doc_id", *others]) + "found binary")


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share enough of their union; many pairs may have one a."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                linked = []
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    merged = np.concatenate([x, y])
                    merged.sort(kind="stable")
                    shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                    linked.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    with Scratch(docs.sparkSession) as keep:
        pairs = keep(pairs)
        sets = _sets(docs, pairs.select(F.col("a").alias("doc_id")).distinct()).select(F.col("doc_id").alias("a"), F.col("found").alias("found_a"))
        both = _sets(docs, pairs.withColumnRenamed("b", "doc_id")).withColumnRenamed("found", "found_b").join(sets, "a")
        return written(both.select("found_a", "found_b", "a", F.col("doc_id").alias("b")).mapInArrow(run, "a long, b long"))


def _forest(linked: list[np.ndarray], row_label: np.ndarray, column_label: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect all that ``linked`` (the columns of each row) and equal labels connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for i, columns in enumerate(linked):
        labels, first = np.unique(column_label[columns], return_index=True)
        for label, at in zip(labels.tolist(), first):
            x, y = find(int(row_label[i])), find(label)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((i, int(columns[at])))
    return out


def _block_links(docs: DataFrame, asks: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Links of documents and the large groups they ask: asks (a, other), members (b, other), groups (rep, n, grp).

    Of all links in a block come as many (a, b) as connect the same groups.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        asking = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, labels = table.column("doc_id").to_numpy(), table.column("grp").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
        rows, columns = np.flatnonzero(asking), np.flatnonzero(~asking)
        sizes = np.array([len(found[i]) for i in columns], np.int64)
        tokens, own = np.concatenate([np.empty(0, np.uint64), *(found[i] for i in columns)]), np.repeat(np.arange(len(columns)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, own, linked = tokens[order], own[order], []
        for i in rows:
            low, high = np.searchsorted(tokens, found[i], "left"), np.searchsorted(tokens, found[i], "right")
            width = high - low
            at = np.repeat(high - width.cumsum(), width) + np.arange(width.sum())  # places of all matches
            shared = np.bincount(own[at], minlength=len(columns))
            linked.append(np.flatnonzero(DEN * shared >= NUM * (len(found[i]) + sizes - shared)))
        links = _forest(linked, labels[rows], labels[columns])
        return pa.table({"a": pa.array([ids[rows[i]] for i, _ in links], pa.int64()), "b": pa.array([ids[columns[j]] for _, j in links], pa.int64())})

    with Scratch(docs.sparkSession) as keep:
        asks, members = keep(asks.join(groups.select(F.col("rep").alias("a"), "n", "grp"), "a")), keep(members.join(groups.select(F.col("rep").alias("b"), "n", "grp"), "b"))
        cuts = lambda name: F.ceil(F.sum("n") / BLOCK_SHINGLES).alias(name)
        chunks = keep(asks.groupBy("other").agg(cuts("rows")).join(members.groupBy("other").agg(cuts("columns")), "other"))
        cell = lambda own, n: F.pmod(F.xxhash64(own), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        asking = asks.join(chunks, "other").select("other", cell("a", F.col("rows")).alias("row"), every(F.col("columns")).alias("column"), F.lit(True).alias("asks"), F.col("a").alias("doc_id"), "grp")
        asked = members.join(chunks, "other").select("other", every(F.col("rows")).alias("row"), cell("b", F.col("columns")).alias("column"), F.lit(False).alias("asks"), F.col("b").alias("doc_id"), "grp")
        rows = keep(asking.unionByName(asked))
        sets = keep(_sets(docs, rows.select("doc_id").distinct()))
        return written(rows.join(sets, "doc_id").groupBy("other", "row", "column").applyInArrow(run, "a long, b long"))


def _alike(a: str, b: str):
    """Sizes which do not rule a link out."""
    return (F.col(a) * NUM <= F.col(b) * DEN) & (F.col(b) * NUM <= F.col(a) * DEN)


def _grouped(docs: DataFrame, full: DataFrame, groups: DataFrame) -> DataFrame:
    """Joins up representatives with central members of their bands."""
    if not BANDS:
        return groups
    with Scratch(docs.sparkSession) as keep:
        keys = full.select("doc_id", F.explode("bands").alias("band")).join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").distinct()
        shared = keys.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
        keys = keep(keep(keys.join(shared, "band")).join(full.select("doc_id", "n", "marks"), "doc_id"))
        central = keep(keys.groupBy("doc_id").agg(F.sum("k").alias("central")))
        tried = None
        for _ in range(ROUNDS):
            sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("size")), "grp")
            placed = keep(keys.join(central, "doc_id").join(sized.select(F.col("rep").alias("doc_id"), "grp", "size"), "doc_id"))
            order = W.partitionBy("band").orderBy(F.col("size").desc(), F.col("central").desc(), "doc_id")
            lead = placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS)
            lead = lead.select("band", F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("grp").alias("other"), F.col("marks").alias("theirs"))
            agree = F.size(F.filter(F.zip_with("marks", "theirs", lambda x, y: x == y), lambda x: x))
            met = placed.join(lead, "band").where("doc_id <> a AND grp <> other").where(_alike("n", "m")).withColumn("agree", agree).where(F.col("agree") >= AGREE)
            met = met.select(F.col("doc_id").alias("b"), "a", "agree").distinct()
            if tried is not None:
                met = met.join(tried, ["a", "b"], "left_anti")
            best = met.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.col("agree").desc(), "a"))).where(F.col("r") <= TRIED).select("a", "b")
            best = keep(best)
            tried = best if tried is None else tried.unionByName(best)
            groups = _regrouped(groups, _links(docs, best))
    return groups


def _regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (rep, n, grp), with the groups of linked representatives joined up."""
    if not links.limit(1).count():
        return groups
    of = groups.select("rep", "grp")
    edges = links.join(of.toDF("a", "ga"), "a").join(of.toDF("b", "gb"), "b").select("ga", "gb")
    found = components(edges, "ga", "gb")
    return written(groups.join(found.toDF("grp", "component"), "grp", "left").select("rep", "n", F.coalesce("component", "grp").alias("grp")))


def _able(docs: DataFrame, groups: DataFrame, hot: dict[bytes, int]) -> DataFrame:
    """The representatives (rep, n, grp) whose prefixes have enough shingles of other groups."""
    of = groups.select("rep", "grp").distinct()
    with Scratch(docs.sparkSession) as keep:
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // KNOWN_SAMPLE))) == 0)
        seen = _prefixes(some, hot).join(of, "rep").groupBy("token").agg(F.count("*").alias("k"), F.min("grp").alias("low"), F.max("grp").alias("high"))
        known = keep(seen.where((F.col("k") >= KNOWN_SEEN) & F.expr("low < high")).select("token", F.lit(True).alias("known")))

        def shared(tokens: DataFrame, what: str) -> DataFrame:
            """Rows of the shingles that several ``what`` have; those of a known shingle need not meet and are spread over tasks."""
            dealt = tokens.withColumn("salt", F.when(F.col("known"), F.pmod(F.xxhash64("rep"), F.lit(1_000))))
            together = W.partitionBy("token", "salt")
            return dealt.withColumns({"low": F.min(what).over(together), "high": F.max(what).over(together)}).where("known OR low < high").drop("salt", "low", "high")

        tokens = shared(_prefixes(docs, hot).join(F.broadcast(known), "token", "left"), "rep")
        counted = shared(tokens.join(of, "rep"), "grp").groupBy("rep", "grp").agg(F.count("*").alias("usable")).join(groups, ["rep", "grp"])
        return written(counted.where(F.col("usable") >= F.lit(SHARE - (1 - NUM / DEN)) * F.col("n") - F.lit(1e-6)).select("rep", "n", "grp"))


def _exploded(docs: DataFrame, able: DataFrame) -> DataFrame:
    """(token, rep, n, grp): all shingles of the given representatives."""
    ids = able.select("rep", "grp").distinct()
    ids = _bounded(ids)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t) for t in part.column(2).to_pylist()]
                sizes = np.array([len(x) for x in found], np.int64)
                repeated = [np.repeat(c, sizes) for c in (part.column(0).to_numpy(), sizes, part.column(1).to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)), *map(pa.array, repeated)], names=["token", "rep", "n", "grp"])

    return docs.join(ids, docs["doc_id"] == ids["rep"]).select("rep", "grp", "text").mapInArrow(run, "token long, rep long, n long, grp long")


def _heads(docs: DataFrame, able: DataFrame) -> DataFrame:
    """The shingles (token, rep, n, grp, width) of which any link to another group has one on both sides; width: how many groups have it."""
    with Scratch(docs.sparkSession) as keep:
        whole = keep(_exploded(docs, able))
        width = whole.select("token", "grp").distinct().groupBy("token").agg(F.count("*").alias("width")).where("width > 1")
        of = W.partitionBy("rep", "n")
        met = whole.join(width, "token").withColumn("usable", F.count("*").over(of)).withColumn("r", F.row_number().over(of.orderBy("width", "token")))
        need = F.ceil(F.col("n") * NUM / DEN)
        return written(met.where(F.col("r") <= F.col("usable") - need + 1).select("token", "rep", "n", "grp", "width"))


def _group_links(docs: DataFrame, heads: DataFrame, groups: DataFrame) -> DataFrame:
    """Links through shingles of few groups."""
    with Scratch(docs.sparkSession) as keep:
        narrow = heads.where(F.col("width") <= MANY)
        sized = keep(narrow.join(groups.groupBy("grp").agg(F.count("*").alias("size")), "grp").select("token", "rep", "n", "grp", "size"))
        matrix = sized.select("token", F.col("grp").alias("other"), F.col("size").alias("others")).distinct()
        asks = "size < others OR (size = others AND grp < other)"
        opened = keep(sized.join(matrix, "token").where(asks).select(F.col("rep").alias("a"), "n", "other", "others").distinct())
        members = groups.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("grp").alias("other"))
        few = opened.where(F.col("others") <= SMALL_GROUP).join(members, "other").where(_alike("n", "m")).select("a", "b").distinct()
        links, large = _links(docs, few), opened.where(F.col("others") > SMALL_GROUP)
        if not large.limit(1).count():
            return links
        asked = large.select("other").distinct()
        return links.unionByName(_block_links(docs, large.select("a", "other").distinct(), members.join(asked, "other", "left_semi").select("b", "other"), groups))


def _family_links(docs: DataFrame, heads: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Links through shingles of many groups: documents meet in the groups of their rarest such shingle."""
    with Scratch(docs.sparkSession) as keep:
        wide = heads.where(F.col("width") > MANY)
        home = keep(wide.groupBy("rep").agg(F.min(F.struct("width", "token"))["token"].alias("home")))
        if home.limit(2).count() < 2:
            return None
        placed = keep(wide.select("token", "rep").distinct().join(home, "rep"))
        matrix = placed.select("token", F.col("home").alias("other")).distinct()
        asks = placed.join(matrix, "token").where("home <= other").select(F.col("rep").alias("a"), "other").distinct()
        return _block_links(docs, asks, home.select(F.col("rep").alias("b"), F.col("home").alias("other")), groups)


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles = written(_profiles(docs))
    full = profiles.where("n > 0 and doc_id is not null")
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("k"))
    copies = written(copies)
    many = copies.where(F.col("k") > F.lit(HOT * full.count())).drop("k").collect()
    hot = F.broadcast(docs.sparkSession.createDataFrame(many, "digest binary, rep long, n long"))
    ids = full.select("doc_id", "digest")
    placed = ids.join(hot, "digest").unionByName(ids.join(hot, "digest", "left_anti").join(copies.drop("k"), "digest"))
    member = written(placed.select("doc_id", "rep", "n").distinct())
    groups = written(member.select("rep", "n").distinct().withColumn("grp", F.col("rep")))

    groups = _grouped(docs, full, groups)
    heads = _heads(docs, _able(docs, groups, {bytes(r.digest): r.rep for r in many}))
    links, more = _group_links(docs, heads, groups), _family_links(docs, heads, groups)
    groups = _regrouped(groups, links if more is None else links.unionByName(more))

    # rows that share an id tie the sets they have together
    placed = member.join(groups.select("rep", "grp").distinct(), "rep")
    several = placed.groupBy("doc_id").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    ties = several.where("low < high")
    if ties.limit(1).count():
        tied = components(placed.join(ties.select("doc_id"), "doc_id", "left_semi").join(several, "doc_id").select("grp", "low"), "grp", "low")
        several = several.join(tied.toDF("low", "component"), "low", "left").select("doc_id", F.coalesce("component", "low").alias("low"))
    found = several.select("doc_id", F.col("low").alias("component_id"))
    return profiles.select("doc_id", "n").join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under shingle similarity."""
    return similar_components(read(spark, sf_dir, "documents"))
