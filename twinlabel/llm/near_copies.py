"""Near copies by a wide SimHash: texts that share four fifths of their five-word shingles.

Two texts with that similarity differ in about 15 % of the bits of their fingerprints, far more
than a tree over whole fingerprints can rule out anything with.  So a fingerprint has 512 bits,
and there is a vantage-point tree over each of 24 pieces of 21 bits: such a pair differs in at
most one bit of some piece with a chance of 0.98, and with that reach a tree prunes well.  Pairs
that a piece finds are compared on all bits, whose number tells the similarity to about 0.03.

Shards, slices and forests are those of :mod:`simhash_dedup`; a few pieces are worked on at a
time, which bounds what is on disk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, drawn, pick, scratch_dir, small, unpack, with_row_key, written
from .components import components
from .simhash_dedup import MAX_LEVELS, SAMPLE_PER_SHARD, SHARD_POINTS, shingle_hashes
from .vantage import Forest, near_pairs, shards_of, top_tree

SHINGLE_WORDS = 5
WORDS = 8
PIECE_BITS, PIECES, REACH = 21, 24, 1
# Differing bits of all 512; about 78 at a similarity of 0.8.
MAX_BITS = 90
# Pieces that are worked on in one go.
_ROUND = 6


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_print(hashes: np.ndarray) -> bytes:
    """512 bits; each is set if it is in more than half of the mixed hashes."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        mixed = _mixed(hashes[at : at + 16384, None] + _SALTS)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hashes")
        ends = hashes.offsets.to_numpy()
        values = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
        out = [wide_print(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), batch.column("_hash"), pa.array(out, pa.binary())],
            names=["_key", "_hash", "print"],
        )


def as_words(prints) -> np.ndarray:
    return np.array(bytearray(b"".join(prints)), dtype=np.uint8).view("<u8").reshape(-1, WORDS)


def gap(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).sum(-1, dtype=np.int64)


def piece_of(words: np.ndarray, piece: int) -> np.ndarray:
    """The bits of one piece of each fingerprint."""
    word, bit = divmod(piece * PIECE_BITS, 64)
    value = words[:, word] >> np.uint64(bit)
    if bit + PIECE_BITS > 64:
        value = value | (words[:, word + 1] << np.uint64(64 - bit))
    return (value & np.uint64(2**PIECE_BITS - 1)).astype(np.uint32)


def _found(points: DataFrame, pieces: list[int], trees: dict[int, list]) -> DataFrame:
    """(a, b): a forest of the pairs that agree in one of the pieces and are near in all bits."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = frame["print"].to_numpy()
            words = as_words(prints)
            for piece in pieces:
                row, shard, home = shards_of(piece_of(words, piece), trees[piece], REACH)
                yield pd.DataFrame(
                    {"piece": np.int32(piece), "shard": shard.astype(np.int32), "home": home, "print": prints[row]}
                )

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        prints = frame["print"].to_numpy()
        words = as_words(prints)
        member = np.flatnonzero(frame["home"].to_numpy())
        asking = np.flatnonzero((frame["own"] == frame["slice"]).to_numpy())
        forest = Forest(len(prints))
        for m, q in near_pairs(
            lambda w: piece_of(w, key[0]), words[member], words[asking], REACH, MAX_BITS, gap=gap
        ):
            forest.add(member[m], asking[q])
        root = forest.merge()
        moved = root != np.arange(len(prints))
        return pd.DataFrame({"a": prints[moved], "b": prints[root[moved]]})

    spark = points.sparkSession
    folder = scratch_dir(spark, "piece-shards")
    dealt = written(
        points.mapInPandas(deal, "piece int, shard int, home boolean, print binary"), "shards", folder
    )
    slices = written(
        dealt.where("home")
        .groupBy("piece", "shard")
        .agg(F.ceil(F.count(F.lit(1)) / (4 * SHARD_POINTS)).cast("int").alias("slices")),
        "shard-slices",
    )
    one = F.pmod(F.xxhash64("print"), F.col("slices")).cast("int")
    placed = dealt.join(small(slices), ["piece", "shard"]).select(
        "piece", "shard", "print", "home", one.alias("own"),
        F.explode(
            F.when(F.col("home"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(one))
        ).alias("slice"),
    )
    pairs = written(
        placed.groupBy("piece", "shard", "slice").applyInPandas(search, "a binary, b binary").distinct(),
        "piece-links",
    )
    clear(spark, folder)
    return pairs


def links(points: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints (column print): forests over the pairs within ``MAX_BITS``
    that some piece finds."""
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log2(max(points.count() / SHARD_POINTS, 2)))))
    bound = SAMPLE_PER_SHARD * 2**levels
    sample = as_words([bytes(r["print"]) for r in drawn(points, bound, "print").take(bound)])
    trees = {piece: top_tree(piece_of(sample, piece), levels) for piece in range(PIECES)}
    found = None
    for first in range(0, PIECES, _ROUND):
        some = _found(points, list(range(first, min(PIECES, first + _ROUND))), trees)
        found = some if found is None else found.unionByName(some)
    return found


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` per component of near copies: that with the smallest doc_id, of rows
    that share it the one with the smallest hash of its text.

    Texts are near copies if their word shingles have a similarity of about 0.8 or more, A-Z
    lower-cased; components are those of chains of near copies.  Null counts as empty; texts
    without words are near copies of each other, and a text of fewer words than a shingle is
    one shingle.  A null id counts as the least long.  An empty table gives no rows.
    """
    prints = written(
        shingle_hashes(docs, shingle).select("_key", "_hash", "hashes").mapInArrow(
            _prints, "_key long, _hash long, print binary"
        ),
        "wide-prints",
    )
    points = written(
        prints.groupBy("print").agg(F.min(F.struct("_key", "_hash")).alias("first")), "distinct-prints"
    )
    joined = written(components(links(points.select("print"))), "print-components")
    labels = points.join(
        joined.select(F.col("node").alias("print"), "component"), "print", "left"
    ).select(F.coalesce("component", "print").alias("component"), "first")
    kept = labels.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    rows = with_row_key(pick(docs, "doc_id", "text", carry=True))
    one = rows.join(kept, ["_key", "_hash"]).dropDuplicates(["_key", "_hash"])
    return unpack(one, docs.columns)
