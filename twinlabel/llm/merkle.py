"""A Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf.  The leaves of a tree are ranked by a range sort: place in the sorted
partition plus the count of what earlier partitions hold.  The three lowest base-8 digits of
the rank number the children of three levels of nodes inside a block of 512 leaves.  Grouping
the digits away one after the other hashes each run of children into its node, which keeps
them as nested structs; all three groupings use one distribution by block.  The hashes of the
blocks are the leaves of the next tier, until a tree has one node left, and the subroots of
all trees form a tree of their own.

Proofs come down the same way: a block's row meets the row with the path above it in one
grouping by block, and transform and explode give each child its siblings' hashes; nothing is
joined.  A row holds one block, never a whole tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick, small, written

FAN_OUT = 8
_DIGITS = 3
_BLOCK = FAN_OUT**_DIGITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left: string, right: string>>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs, one after the other, in UTF-8."""
    return F.sha2(F.concat(*inputs), 256)


def framed(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with ``rank`` from 0 and ``total`` per ``tree``, ordered by ``order``; rows that
    agree in all of it are dealt by their place in the input."""
    keys = ["tree", *order, "_place"]
    rows = written(
        leaves.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_place")
        .withColumn("_at", F.monotonically_increasing_id()),
        "sorted-leaves",
    ).withColumn("_part", F.shiftright("_at", 33))
    # One row per tree and partition, which are as many as partitions and trees together.
    earlier = Window.partitionBy("tree").orderBy("_part")
    spans = written(
        rows.groupBy("tree", "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select(
            F.col("tree").alias("_tree"),
            F.col("_part").alias("_span"),
            (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_shift"),
            F.sum("_n").over(Window.partitionBy("tree")).alias("total"),
        ),
        "spans",
    )
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_span"))
    return (
        rows.join(small(spans), same)
        .withColumn("rank", F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_tree", "_span", "_shift")
    )


def _nodes_at(level: int) -> Column:
    """Nodes of the whole tree so many levels above the leaves of this tier."""
    return F.ceil(F.col("total") / FAN_OUT**level).cast("long")


def _rolled(leaves: DataFrame) -> DataFrame:
    """Blocks of leaves (tree, total, rank, hash, item): their hash and nested children."""
    digits = [
        F.expr(f"CAST(rank DIV {FAN_OUT**i} % {FAN_OUT} AS INT)").alias(f"_d{i}")
        for i in range(_DIGITS)
    ]
    nodes = leaves.select(
        "tree", "total", F.expr(f"rank DIV {_BLOCK}").alias("block"), *digits, "hash", "item"
    ).repartition("tree", "block")
    inner = "item"
    for level in range(_DIGITS):
        left = [f"_d{i}" for i in range(level + 1, _DIGITS)]
        child = F.struct(F.col(f"_d{level}").alias("at"), "hash", inner)
        nodes = (
            nodes.groupBy("tree", "total", "block", *left)
            .agg(F.sort_array(F.collect_list(child)).alias("kids"))
            .withColumn(
                "hash",
                F.when(
                    _nodes_at(level) > 1,
                    digest(F.array_join(F.col("kids.hash"), "")),
                ).otherwise(F.col("kids")[0]["hash"]),
            )
        )
        inner = "kids"
    return nodes


def _tiers(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of leaves, blocks of those blocks and so on, until every tree is one block."""
    tiers: list[DataFrame] = []
    while True:
        blocks = written(_rolled(leaves), f"tier-{len(tiers)}")
        tiers.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= _BLOCK:
            return tiers
        leaves = blocks.select(
            "tree",
            _nodes_at(_DIGITS).alias("total"),
            F.col("block").alias("rank"),
            "hash",
            F.lit(None).cast("string").alias("item"),
        )


def _with_siblings(kids: Column, several: Column) -> Column:
    """Each child with the hashes of the others of its run before and after it; a level that
    has one node has none."""

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda k: k["hash"]), "")

    def child(kid: Column, i: Column) -> Column:
        sides = F.struct(
            joined(F.slice(kids, F.lit(1), i)).alias("left"),
            joined(F.slice(kids, i + 2, F.lit(FAN_OUT))).alias("right"),
        )
        own = F.when(several, F.array(sides)).otherwise(F.array().cast(_STEP))
        return F.struct(kid.alias("kid"), own.alias("step"))

    return F.transform(kids, child)


def _descended(blocks: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """Children of the blocks with their whole paths, given the path of each block."""
    known = ["path", *carried]
    kinds = {f.name: f.dataType for f in [*blocks.schema, *above.schema]}
    own = blocks.select(
        "tree", "block", "total", "kids", *[F.lit(None).cast(kinds[c]).alias(c) for c in known]
    )
    other = above.select(
        "tree",
        "block",
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ("total", "kids")],
        *known,
    )
    rows = own.unionByName(other).groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("total", "kids", *known)]
    )
    rows = rows.where(F.col("kids").isNotNull()).withColumn("rank", F.col("block"))
    for level in reversed(range(_DIGITS)):
        kid = F.col("_kid.kid")
        rows = rows.withColumn(
            "_kid", F.explode(_with_siblings(F.col("kids"), _nodes_at(level) > 1))
        ).select(
            "tree",
            "total",
            (F.col("rank") * FAN_OUT + kid["at"]).alias("rank"),
            *([kid["kids"].alias("kids")] if level else [kid["hash"].alias("hash"), kid["item"].alias("item")]),
            F.concat(F.col("_kid.step"), F.col("path")).alias("path"),
            *carried,
        )
    return rows


def _proven(tiers: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
    """Leaves of the lowest tier with their paths, given the path of each tree's top block."""
    for blocks in reversed(tiers[1:]):
        above = _descended(blocks, above, *carried).withColumn("block", F.col("rank"))
    return _descended(tiers[0], above, *carried)


def proofs(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (tree, hash, item and the columns of ``order``) with subroot, root and path.

    A tree's leaves stand in the order of ``order``; every 8 consecutive nodes become one,
    until one is left, the subroot.  Subroots, by tree (null first, by UTF-8 bytes), give
    the root in the same way.  ``path`` lists, from the leaf up, the hashes that stand left
    and right of the own one in its run.  No leaves give no rows.
    """
    ranked = _ranked(leaves, *order)
    tiers = _tiers(ranked.select("tree", "total", "rank", "hash", "item"))
    tops = tiers[-1].select(
        F.lit(0).alias("tree"), F.col("tree").alias("lang"), "hash", F.struct("tree").alias("item")
    )
    crowns = _tiers(_ranked(tops, "lang").drop("lang"))
    top = crowns[-1].select(
        "tree", "block", F.array().cast(_STEP).alias("path"), F.col("hash").alias("root")
    )
    subroots = _proven(crowns, top, "root").select(
        F.col("item.tree").alias("tree"),
        F.lit(0).cast("long").alias("block"),
        "path",
        F.col("hash").alias("subroot"),
        "root",
    )
    return _proven(tiers, written(subroots, "subroots"), "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def audited(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each framed; a tree is a
    language, its leaves ascend by doc_id (null first; equal ids by their leaves).
    ``folded_root`` comes from the leaf of the text as it would be after tampering, which
    lower-cases A-Z of the text where 3 divides the crc32 of the decimal id; null ids and
    null texts are left as they are.  Rows that repeat are leaves of their own.  An empty
    table gives no rows.  Other columns are not looked at, whatever their names.
    """
    rows = pick(docs, *COLUMNS)

    def leaf(text: Column) -> Column:
        return digest(*[framed(F.col(c)) for c in COLUMNS[:-1]], framed(text))

    tampering = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = rows.select(
        F.col("lang").alias("tree"),
        F.col("doc_id").alias("key"),
        leaf(F.col("text")).alias("hash"),
        F.struct(
            "doc_id", F.when(tampering, leaf(ascii_lower(F.col("text")))).alias("tampered")
        ).alias("item"),
    )
    found = proofs(leaves, "key", "hash")
    siblings = F.transform("path", lambda step: F.concat(step["left"], step["right"]))
    return found.select(
        F.col("item.doc_id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("item.tampered", "hash"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
