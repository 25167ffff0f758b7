"""A Merkle manifest of a dataset: one root for all rows, and for each row a proof that it belongs to it.

Rows are leaves, in an order within a group; eight neighbours make a parent, up to one
subroot of each group, and the subroots make the root in the same way. The digest of
a node is hex, so a level of the tree is a string in which every node has 64 characters.

The rows are numbered densely within their group by ranges of the order (``numbered``): the
only shuffle of all rows by a sort, of digests and keys, never of texts. Then every aligned
block of 512 nodes becomes one row (``blocks_of``) which keeps its levels as one
string each: parents are hashes of fixed-width substrings, and the siblings of a node are the
substrings to its left and right. A block's top is a node of the next round, which
has 512 times fewer; rounds go on until each group has one node, and the subroots go
through the same rounds (``ascend``). On the way back (``descend``) each block hands
its path to the root to its nodes, so a row gets its proof from its own block and one
row of the table above, however large its group is: a group with most of all rows is
many blocks.

Ranges and rounds are written to the shared folder, because ranges drawn again could
differ; what is needed no longer is deleted. Blocks of 512 nodes bound every row.

Cases: null values have digests of their own, apart from empty ones; rows which
share order and digest are neighbours and each has its own place; an empty table has no
rows; null groups and null keys come first; texts of any length count whole; further
columns of the leaves ride along, whatever their names, but for the operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geofeat.llm.common import read, written
from geofeat.sources.shared import Scratch

#: Nodes under one parent; levels, and so nodes, of a block; characters of a digest.
RUN, LEVELS, HEX = 8, 3, 64
BLOCK = RUN**LEVELS
#: Rows of a table that may be sent to all tasks, at most; it has one for each range and group.
SMALL = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its count of UTF-8 bytes, a colon and its text, or as a dash if null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def numbered(nodes: DataFrame, group: str, order: list[str], keep) -> DataFrame:
    """Adds ``_at``, dense from 0 within the group in the given order, and ``_n``, the group's rows. ``group`` must not be null."""
    dealt = nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = keep(dealt.withColumn("_m", F.monotonically_increasing_id()))  # partition and place in it
    part = F.shiftright("_m", 33)
    sizes = dealt.groupBy(group, part.alias("_part")).agg(F.min("_m").alias("_first"), F.count("*").alias("_k"))
    of = W.partitionBy(group)
    offsets = keep(sizes.select(group, "_part", "_first", (F.sum("_k").over(of.orderBy("_part")) - F.col("_k")).alias("_before"), F.sum("_k").over(of).alias("_n")))
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)
    placed = dealt.withColumn("_part", part).join(offsets, [group, "_part"])
    return placed.withColumn("_at", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_part", "_first", "_before")


def _nodes_of(level: Column, start: Column, count: Column) -> Column:
    """The digests of ``count`` nodes of a level, from place ``start`` (0 is the first); what lies behind its end is not there."""
    return F.substring(level, (start * HEX + 1).cast("int"), (count * HEX).cast("int"))


def _parents(level: Column) -> Column:
    """The level above: each run of ``RUN`` nodes is hashed, be it complete or not."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (RUN * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(_nodes_of(level, i * RUN, F.lit(RUN)), 256)), "").cast("binary")


def blocks_of(nodes: DataFrame, row: list[str]) -> DataFrame:
    """One row for each block of nodes (_g, _at, _n, _node and the columns ``row``): its nodes, its levels and its top."""
    held = F.array_sort(F.collect_list(F.struct("_at", "_node", *row)))
    out = nodes.groupBy("_g", "_n", F.floor(F.col("_at") / BLOCK).alias("_block")).agg(held.alias("_nodes"))
    # levels which this block adds; as its group may have fewer nodes than a block, not always all
    depth = reduce(lambda deeper, k: F.when(F.col("_n") <= RUN**k, k).otherwise(deeper), reversed(range(LEVELS)), F.lit(LEVELS))
    out = out.withColumn("_depth", depth).withColumn("_l0", F.array_join(F.col("_nodes._node"), "").cast("binary"))
    for k in range(LEVELS):
        out = out.withColumn(f"_l{k + 1}", F.when(F.col("_depth") > k, _parents(F.col(f"_l{k}"))))
    top = F.coalesce(*[F.col(f"_l{k}") for k in range(LEVELS, -1, -1)])
    return out.withColumn("_top", top.cast("string")).drop(f"_l{LEVELS}")


def ascend(nodes: DataFrame, row: list[str]) -> list[DataFrame]:
    """The rounds of blocks, from the nodes up to one block of each group; its top is the group's root."""
    rounds = [written(blocks_of(nodes, row))]
    while rounds[-1].where(F.col("_n") > BLOCK).limit(1).count():
        tops = rounds[-1].select("_g", F.col("_block").alias("_at"), F.ceil(F.col("_n") / BLOCK).alias("_n"), F.col("_top").alias("_node"))
        rounds.append(written(blocks_of(tops, [])))
    return rounds


def descend(rounds: list[DataFrame], paths: DataFrame, row: list[str]) -> DataFrame:
    """The nodes (columns ``row``) of the first round, with what paths (_g, _path, ...) holds of their group and their own path up to it.

    A path is an array of (left, right), the siblings on both sides, from the node's own level on.
    """
    more = [c for c in paths.columns if c not in ("_g", "_path")]
    paths = paths.withColumn("_block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        names = row if k == 0 else []

        def flanks(j: Column, level: int) -> Column:
            own = F.floor(j / RUN**level)
            first = F.floor(own / RUN) * RUN
            return F.struct(_nodes_of(F.col(f"_l{level}"), first, own - first).cast("string").alias("left"), _nodes_of(F.col(f"_l{level}"), own + 1, first + RUN - 1 - own).cast("string").alias("right"))

        node = lambda x, j: F.struct(x["_at"].alias("_at"), F.slice(F.array(*[flanks(j, v) for v in range(LEVELS)]), F.lit(1), F.col("_depth")).alias("_own"), *[x[c].alias(c) for c in names])  # noqa: B023, E731
        met = rounds[k].join(paths, ["_g", "_block"]).select("_g", "_path", *more, F.explode(F.transform("_nodes", node)).alias("_x"))
        paths = met.select("_g", F.col("_x._at").alias("_block"), F.concat("_x._own", "_path").alias("_path"), *more, *[F.col(f"_x.{c}") for c in names])
    return paths.drop("_block")


def proofs(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """The rows of ``leaves`` with ``subroot``, ``root`` and ``path``.

    leaves: a column of digests, a text column ``group``, the columns ``order``, and
    narrow ones which ride along. Equal rows of the order go by their digest.
    """
    row = leaves.columns
    spark, no_path = leaves.sparkSession, F.array().cast("array<struct<left:string,right:string>>")
    with Scratch(spark) as keep:
        key = F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit(""))  # null first, then by bytes
        placed = numbered(keep(leaves.withColumn("_g", key)), "_g", [*order, leaf], keep)
        below = ascend(placed.withColumn("_node", F.col(leaf)), row)
        subroots = below[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_of"), F.col("_top").alias("_node"))
        above = ascend(numbered(subroots, "_g", ["_of"], keep), ["_of"])
    top = above[-1].select("_g", no_path.alias("_path"), F.col("_top").alias("root"))
    groups = descend(above, top, ["_of"]).select(F.col("_of").alias("_g"), "_path", "root")
    found = below[-1].select("_g", F.col("_top").alias("subroot")).join(groups, "_g")
    return descend(below, found, row).select(*row, "subroot", "root", F.col("_path").alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, and what the proofs say after a third of the texts were tampered with."""
    docs = read(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf_digest(*fields(F.col("text"))).alias("leaf"), F.when(tampered, leaf_digest(*fields(F.translate("text", UPPER, UPPER.lower())))).alias("tampered"))
    found = proofs(leaves, "lang", ["doc_id"])
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 9, group_levels: int = 4) -> str:
    """The same for up to 8^levels documents of a language and 8^group_levels languages, level by level."""
    byte_list = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}), lambda c, b: {bits}), 4294967295)"
    part = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    out = [
        f"h AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} END AS tampered FROM documents)",
        "o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang, doc_id, leaf) AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h)",
        "n0 AS MATERIALIZED (SELECT lang AS g, i, n, leaf AS d FROM o)",
        "p0 AS MATERIALIZED (SELECT k, lang AS g, i, '' AS proof, coalesce(tampered, leaf) AS f FROM o)",
    ]

    def climb(n: str, p: str, up_to: int) -> None:
        for v in range(up_to):
            out.append(f"r{n}{v} AS MATERIALIZED (SELECT g, i // 8 AS up, list(d ORDER BY i) AS ds, any_value(n) AS n FROM {n}{v} GROUP BY g, i // 8)")
            out.append(f"{n}{v + 1} AS MATERIALIZED (SELECT g, up AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{n}{v})")
            sides = f"(SELECT k, p.g, i // 8 AS i, proof, f, n, array_to_string(ds[1:i % 8], '') AS a, array_to_string(ds[i % 8 + 2:], '') AS b FROM {p}{v} p JOIN r{n}{v} r ON p.g IS NOT DISTINCT FROM r.g AND p.i // 8 = r.up)"
            out.append(f"{p}{v + 1} AS MATERIALIZED (SELECT k, g, i, CASE WHEN n > 1 THEN proof || a || b ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256(a || f || b) ELSE f END AS f FROM {sides} x)")

    climb("n", "p", levels)
    out.append(f"s AS MATERIALIZED (SELECT g AS lang, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{levels})")
    out.append("m0 AS MATERIALIZED (SELECT 0 AS g, i, n, subroot AS d FROM s)")
    out.append(f"q0 AS MATERIALIZED (SELECT k, 0 AS g, s.i, proof, f FROM p{levels} p JOIN s ON p.g IS NOT DISTINCT FROM s.lang)")
    climb("m", "q", group_levels)
    last = f"FROM o JOIN q{group_levels} q ON o.k = q.k JOIN s ON o.lang IS NOT DISTINCT FROM s.lang, m{group_levels} m"
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, m.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m.d AS verified {last}"


OP12_SQL = _sql()
