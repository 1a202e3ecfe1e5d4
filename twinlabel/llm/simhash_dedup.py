"""Near duplicates by SimHash, found with vantage-point trees.

Shingle hashes are Spark expressions; their bits are counted per document in numpy.  Equal
fingerprints are one point.  The upper levels of one tree per half of the fingerprint (see
:mod:`vantage`), grown from a bounded sample, deal the points to shards: each point lives in
one shard and is a query in every shard its ball overlaps, so all pairs are found.  Inside
a shard a tree is grown over all its points.  A shard gives back a spanning forest of its
links, never all pairs, and the forests are joined to components.

A shard with more points than ``SHARD_POINTS`` is worked on in slices of its queries, each
against all of its points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drawn, pick, small, unpack, with_row_key, written
from .components import components
from .vantage import Forest, near_pairs, shards_of, top_tree

SHINGLE_WORDS = 3
MAX_BITS = 3
# Points meant for one shard, and the levels of the upper tree at most.
SHARD_POINTS = 20_000
MAX_LEVELS = 14
# Points per shard in the sample that places the upper levels; at most 2**20 in all.
SAMPLE_PER_SHARD = 64


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hashes")
        ends = hashes.offsets.to_numpy()
        bits = hashes.values.to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(hashes), dtype=np.int64)
        for i, (start, end) in enumerate(zip(ends[:-1], ends[1:])):
            ones = np.zeros(64, dtype=np.int64)
            for at in range(start, end, 65536):
                block = np.unpackbits(bits[at : min(end, at + 65536)], axis=1, bitorder="little")
                ones += block.sum(0, dtype=np.int64)
            out[i] = np.packbits(ones * 2 > end - start, bitorder="little").view(np.int64)[0]
        kept = [batch.column(name) for name in ("doc_id", "_key", "_hash")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(out)], names=["doc_id", "_key", "_hash", "fingerprint"]
        )


def shingle_hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, _key, _hash, hashes) per row, a hash per shingle of so many words."""
    rows = with_row_key(pick(docs, "doc_id", "text"))
    lower = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    words = rows.select(
        "doc_id", "_key", "_hash", F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), "").alias("w")
    )
    # The words again from the second, the third, ...: row i of the zip is shingle i.
    shifted = F.arrays_zip(
        *[F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(shingle)]
    )
    full = F.slice(shifted, 1, F.greatest(F.size("w") - shingle + 1, F.lit(0)))
    hashes = F.transform(
        full, lambda x: F.xxhash64(F.concat_ws(" ", *[x[f"w{i}"] for i in range(shingle)]))
    )
    return words.select(
        "doc_id",
        "_key",
        "_hash",
        F.when(F.size("w") >= shingle, hashes)
        .when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w"))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("hashes"),
    )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _key, _hash, fingerprint) per row, the fingerprint as a signed long."""
    return shingle_hashes(docs, shingle).mapInArrow(
        _fingerprints, "doc_id long, _key long, _hash long, fingerprint long"
    )


def _half(values: np.ndarray, side: int) -> np.ndarray:
    return ((values >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): a spanning forest of the pairs of distinct fingerprints (column fingerprint)
    that differ in at most ``max_bits`` bits."""
    reach = max_bits // 2
    count = points.count()
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log2(max(count / SHARD_POINTS, 2)))))
    bound = SAMPLE_PER_SHARD * 2**levels
    sample = np.array(
        [r["fingerprint"] for r in drawn(points, bound, "fingerprint").take(bound)],
        dtype=np.int64,
    ).view(np.uint64)
    trees = [top_tree(_half(sample, side), levels) for side in (0, 1)]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fingerprint"].to_numpy().view(np.uint64)
            for side, nodes in enumerate(trees):
                row, shard, home = shards_of(_half(values, side), nodes, reach)
                yield pd.DataFrame(
                    {
                        "side": np.int32(side),
                        "shard": shard.astype(np.int32),
                        "home": home,
                        "fingerprint": values[row].view(np.int64),
                    }
                )

    dealt = written(
        points.select("fingerprint").mapInPandas(
            deal, "side int, shard int, home boolean, fingerprint long"
        ),
        "shards",
    )
    slices = written(
        dealt.where("home")
        .groupBy("side", "shard")
        .agg(F.ceil(F.count(F.lit(1)) / (4 * SHARD_POINTS)).cast("int").alias("slices")),
        "shard-slices",
    )
    one = F.pmod(F.xxhash64("fingerprint"), F.col("slices")).cast("int")
    placed = dealt.join(small(slices), ["side", "shard"]).select(
        "side",
        "shard",
        "fingerprint",
        # Each slice has all points that live in the shard as members, and its own queries.
        F.explode(
            F.when(F.col("home"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(one))
        ).alias("slice"),
        "home",
        one.alias("own"),
    )

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["fingerprint"].to_numpy().view(np.uint64)
        member = np.flatnonzero(frame["home"].to_numpy())
        asking = np.flatnonzero((frame["own"] == frame["slice"]).to_numpy())
        forest = Forest(len(values))
        for m, q in near_pairs(
            lambda v: _half(v, key[0]), values[member], values[asking], reach, max_bits
        ):
            forest.add(member[m], asking[q])
        root = forest.merge()
        moved = root != np.arange(len(values))
        return pd.DataFrame(
            {"a": values[moved].view(np.int64), "b": values[root[moved]].view(np.int64)}
        )

    return placed.groupBy("side", "shard", "slice").applyInPandas(search, "a long, b long")


def _labelled(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    prints = written(fingerprints(docs, shingle), "fingerprints")
    points = written(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints"
    )
    joined = written(components(links(points, max_bits)), "fingerprint-components")
    labels = points.join(
        joined.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left"
    ).select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least")
    smallest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labels.join(smallest, "component").select("fingerprint", "component", "component_id")
    return prints.join(named, "fingerprint")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """Per document: its fingerprint in hex and component_id, the smallest doc_id reachable
    over links of at most ``max_bits`` differing bits, its own included.

    A null text has no words; a text without words has fingerprint zero and links like any
    other, one with fewer words than a shingle is one shingle.  A null id is passed over as
    component id unless the whole component has no other.  Repeated rows get equal results;
    an empty table gives no rows.
    """
    return _labelled(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of ``docs`` per component, with the doc_id of the component.

    Components are told apart by their fingerprints, so those that share a doc_id, or have
    none, keep a row each.
    """
    kept = (
        _labelled(docs, shingle, max_bits)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min(F.struct("_key", "_hash")).alias("first"))
        .select("first._key", "first._hash")
    )
    rows = with_row_key(pick(docs, "doc_id", "text", carry=True))
    one = rows.join(kept, ["_key", "_hash"]).dropDuplicates(["_key", "_hash"])
    return unpack(one, docs.columns)
