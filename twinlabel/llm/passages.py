"""Fuzzy passages that documents share, by collinear chaining.

1. Seeds are k-mers of words chosen by a sliding minimum, a narrow table.  Those that stand
   in one document only go.
2. Shared seeds are joined.  The places of a seed that stands in few are all held against each
   other; of those that share a whole passage, each against the first.  The places of one that
   stands in many are compared by the words around them: runs of three words that few of them hold
   find pairs, and places that differ in other words only are one class, so that a line in a third
   of all documents never gives all pairs.
3. Per pair of documents the matches are chained (Fenwick tree, gap costs).  A seed of a pair so
   found is a chain by itself: of a passage with a tenth of its words changed there is often no
   more.  Other seeds must make a chain of some length.
4. The words around each chain are cut out of both documents and aligned; what has enough
   matches and few enough differences is a passage.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chaining import Contexts, align, chains, seeds, stretches
from .common import clear, pick, scratch_dir, small, with_row_key, written
from .decontamination import words_of

SEED_WORDS = 8
SEED_WINDOW = 16
LEAST_WORDS = 50
IDENTITY = 0.8
# The price of a skipped word in a chain.
GAP_COST = 0.2
# Words beside a chain that are looked at for the passage's ends.
FLANK = 60
# Words that a chain of common seeds spans at least: what any LEAST_WORDS equal words have.
_SPAN = max(SEED_WORDS, LEAST_WORDS - 2 * (SEED_WINDOW - 1))
# Places of a seed, or of a run of words around it, that are all held against each other.
FEW = 16
# Words after a seed that make a passage with it.
_NEXT = LEAST_WORDS - SEED_WORDS
# Words around a seed that decide whether two of its places may align; places in a block.
_AROUND, BLOCK = 2 * FLANK + SEED_WORDS, 16384
# Slices cut out of one copy of a document.
SLICES = 1000
_ROW = ["_key", "_hash"]


def _hashed(docs: DataFrame) -> DataFrame:
    rows = with_row_key(pick(docs, "doc_id", "text"))
    return rows.select(*_ROW, F.transform(words_of("text"), lambda w: F.xxhash64(w)).alias("words"))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, code = batch.column("_key").to_numpy(), batch.column("_hash").to_numpy()
        lists = batch.column("words")
        ends, words = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        found = [seeds(words[s:e], SEED_WORDS, SEED_WINDOW) for s, e in zip(ends[:-1], ends[1:])]
        row = np.repeat(np.arange(len(found)), [len(p) for _, p in found])
        if len(row):
            place = np.concatenate([p for _, p in found])
            start, stop = ends[:-1][row] + place + SEED_WORDS, ends[1:][row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([g for g, _ in found]).view(np.int64)),
                    pa.array(key[row]),
                    pa.array(code[row]),
                    pa.array(place.astype(np.int32)),
                    pa.array(stretches(words, start, [np.minimum(start + _NEXT, stop)])[0]),
                ],
                names=["gram", "_key", "_hash", "position", "far"],
            )


def _shared(found: DataFrame) -> DataFrame:
    """Seeds in more than one document row, with the smallest document key that holds them and
    whether they stand in few places."""
    ends = (
        found.groupBy("gram")
        .agg(
            F.min("_key").alias("low"),
            (F.min("_key") != F.max("_key")).alias("spread"),
            (F.min("_hash") != F.max("_hash")).alias("several"),
            (F.count(F.lit(1)) <= FEW).alias("few"),
        )
        .where(F.col("spread") | F.col("several"))
        .select("gram", "low", "few")
    )
    # As tables of their own, both sides are shuffled for the join only, and the engine may
    # split a seed that very many documents share.
    return found.join(written(ends, "shared-grams"), "gram").select(
        "gram", *_ROW, "position", "far", "low", "few"
    )


_MATCH = [*_ROW, "other_key", "other_hash", "position", "other", "sure"]


def _all_pairs(places: DataFrame, by: list[str], far: Column) -> DataFrame:
    """Matches of the places of a group that are in different documents; groups are small.  Of
    places with equal ``far``, which share a passage, each is matched with the first only; that
    is no sure match, as their other seeds say the same."""
    groups = places.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(*_ROW, "position", far.alias("far")))).alias("places")
    )
    row = lambda p: F.struct(p["_key"], p["_hash"])
    same = lambda a, b: F.coalesce(a["far"] == b["far"], F.lit(False))
    pairs = F.flatten(
        F.transform(
            "places",
            lambda a: F.transform(
                F.filter(
                    "places",
                    lambda b: (row(a) < row(b))
                    & (~same(a, b) | ~F.exists("places", lambda c: (row(c) < row(a)) & same(c, a))),
                ),
                lambda b: F.struct(
                    *[a[c].alias(c) for c in _ROW], b["_key"].alias("other_key"),
                    b["_hash"].alias("other_hash"), a["position"].alias("position"),
                    b["position"].alias("other"),
                    (~same(a, b) | (F.size("places") == 2)).cast("int").alias("sure"),
                ),
            ),
        )
    )
    return groups.select(F.explode(pairs).alias("m")).select("m.*")


_CONTEXT = "gram long, part int, _key long, _hash long, position int, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each asked place of a document.  Places of a seed that overlap are a few
    words over and over: the first and the last of them stand for all, as an alignment passes one
    of the two ends or has no more than those words.  Of places with equal words around them the
    first stands.  A row goes to every pair of blocks that its block is in."""
    for batch in batches:
        lists, asks = batch.column("words"), batch.column("asked")
        ends, words = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = asks.offsets.to_numpy()
        gram, place, blocks = (asks.values.field(c).to_numpy() for c in ("gram", "position", "blocks"))
        row = np.repeat(np.arange(len(batch)), np.diff(cuts))
        gram, place, blocks = (c[cuts[0] : cuts[-1]] for c in (gram, place, blocks))
        order = np.lexsort((place, gram, row))
        row, gram, place, blocks = row[order], gram[order], place[order], blocks[order]
        apart = (np.diff(row) != 0) | (np.diff(gram) != 0) | (np.diff(place) >= SEED_WORDS)
        ends_run = np.append(True, apart) | np.append(apart, True)
        row, gram, place, blocks = row[ends_run], gram[ends_run], place[ends_run], blocks[ends_run]
        key, code = (batch.column(c).to_numpy()[row] for c in _ROW)
        short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        weight = np.cumprod(np.full(_AROUND, 0x9E3779B97F4A7C15, np.uint64))
        for at in range(0, len(row), 10_000):
            part = slice(at, at + 10_000)
            index = (ends[row[part]] + place[part])[:, None] + np.arange(-FLANK, _AROUND - FLANK)
            inside = (index >= ends[row[part]][:, None]) & (index < ends[row[part] + 1][:, None])
            around = np.where(inside, short[np.clip(index, 0, len(short) - 1)], np.uint32(0))
            mark = (around.astype(np.uint64) * weight).sum(1)
            _, first = np.unique(np.stack([row[part], gram[part], mark.view(np.int64)], 1), axis=0, return_index=True)
            first.sort()
            n, mine = blocks[part][first].astype(np.int64), (code[part][first] >> 7) % blocks[part][first]
            # Blocks are dealt in pairs; a lone one is a pair with itself.
            times = np.maximum(n - 1, 1)
            again = np.repeat(np.arange(len(first)), times)
            other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            other += (other >= mine[again]) & (n[again] > 1)
            pair = np.minimum(mine[again], other) * 32768 + np.maximum(mine[again], other)
            chosen = first[again]
            for s in range(0, len(chosen), 10_000):
                c = chosen[s : s + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[part][c]), pa.array(pair[s : s + 10_000].astype(np.int32)), pa.array(key[part][c]),
                     pa.array(code[part][c]), pa.array(place[part][c].astype(np.int32)),
                     pa.array([x.tobytes() for x in around[c]], pa.binary())],
                    names=[c.split()[0] for c in _CONTEXT.split(", ")],
                )


def _closest(rows: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Matches of places (_key, _hash, position), in this order, of a seed with the words around them."""
    document = np.cumsum(np.append(0, (rows[1:, :2] != rows[:-1, :2]).any(1)))
    _, first, equal = np.unique(around, axis=0, return_index=True, return_inverse=True)
    found = Contexts(around[first])
    one, two, classes = found.pairs(FEW, LEAST_WORDS)
    # The first place of each group, and the first in another document than that.
    links = []
    for group in (np.where((around != 0).sum(1) >= LEAST_WORDS, equal, -1), classes[equal]):
        member = np.flatnonzero(group >= 0)
        lead = np.full(len(first), len(rows))
        np.minimum.at(lead, group[member], member)
        links.append(np.stack([lead[group[member]], member], 1))
    lead = np.full((2, len(first)), len(rows))
    np.minimum.at(lead[0], equal, np.arange(len(rows)))
    further = np.flatnonzero(document != document[lead[0][equal]])
    np.minimum.at(lead[1], equal[further], further)
    lead = np.where(lead < len(rows), lead, lead[0])
    for a, b in ((0, 0), (0, 1), (1, 0)):
        # Where the first places are in one document, either group offers its next.
        use = slice(None) if a == b else document[lead[0][one]] == document[lead[0][two]]
        links.append(np.stack([lead[a][one[use]], lead[b][two[use]]], 1))
    link = np.concatenate(links)
    link = link[document[link[:, 0]] != document[link[:, 1]]]
    link = np.unique(np.sort(link, axis=1), axis=0)
    # Of the places of a document that go with one place, the first: every place keeps a partner
    # in every document where it has one, but repeats inside documents do not multiply.
    kept = []
    for here, there in ((0, 1), (1, 0)):
        order = np.lexsort((link[:, there], link[:, here]))
        sides = np.stack([link[order, here], document[link[order, there]]], 1)
        kept.append(order[np.unique(sides, axis=0, return_index=True)[1]])
    link = link[np.unique(np.concatenate(kept))]
    a, b = rows[link[:, 0]], rows[link[:, 1]]
    return np.concatenate([a[:, :2], b[:, :2], a[:, 2:], b[:, 2:]], 1)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of each seed and pair of blocks; their places come in a row."""
    held: list[tuple] = []

    def solve(rows: np.ndarray, around: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = _closest(rows[:, 2:], np.stack(around))
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            arrays = [pa.array(part[:, c], pa.int64() if c < 4 else pa.int32()) for c in range(6)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.ones(len(part), np.int32))], names=_MATCH)

    for batch in batches:
        if not len(batch):
            continue
        table = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "part", *_ROW, "position")], 1)
        around = [np.frombuffer(x, np.uint32) for x in batch.column("context").to_pylist()]
        bounds = np.flatnonzero(np.append((table[1:, :2] != table[:-1, :2]).any(1), True)) + 1
        if held and (held[0][0][0, :2] != table[0, :2]).any():
            yield from solve(np.concatenate([t for t, _ in held]), [x for _, c in held for x in c])
            held = []
        start = 0
        for end in bounds:
            held.append((table[start:end], around[start:end]))
            if end < len(table):
                yield from solve(np.concatenate([t for t, _ in held]), [x for _, c in held for x in c])
                held = []
            start = end
    if held:
        yield from solve(np.concatenate([t for t, _ in held]), [x for _, c in held for x in c])


def _by_context(places: DataFrame, hashed: DataFrame) -> DataFrame:
    """Matches of places of seeds in many, by the words around them: all pairs that may align in
    ``LEAST_WORDS`` words, but of equal words around a seed, or of such as differ in words that few
    hold only, each with the first.  A seed of more than ``BLOCK`` places is held against itself a
    pair of blocks at a time."""
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    sized = written(places.groupBy("gram").agg(blocks), "seed-blocks")
    asked = (
        places.select("gram", *_ROW, "position").join(sized, "gram")
        .groupBy(*_ROW).agg(F.collect_list(F.struct("gram", "position", "blocks")).alias("asked"))
    )
    words = hashed.dropDuplicates(_ROW).join(asked, _ROW).select(*_ROW, "words", "asked")
    return (
        words.mapInArrow(_contexts, _CONTEXT)
        .repartition("gram", "part")
        .sortWithinPartitions("gram", "part", *_ROW, "position")
        .mapInArrow(_close, "_key long, _hash long, other_key long, other_hash long, position int, other int, sure int")
    )


def _standing(places: DataFrame) -> DataFrame:
    """Matches of each place of a seed with its first place in the document of the smallest key:
    no links of their own, they lengthen the chains of links."""
    stands = (
        places.where(F.col("_key") == F.col("low"))
        .groupBy("gram")
        .agg(F.min(F.struct("_hash", "position")).alias("first"))
        .select("gram", F.col("first._hash").alias("first_hash"), F.col("first.position").alias("first_position"))
    )
    rows = places.join(written(stands, "standing-documents"), "gram")
    return rows.where((F.col("_key") != F.col("low")) | (F.col("_hash") != F.col("first_hash"))).select(
        *_turned(F.struct(F.col("low").alias("_key"), F.col("first_hash").alias("_hash"),
                          F.col("first_position").alias("position")),
                 F.struct(*_ROW, "position")),
        F.lit(0).alias("sure"),
    )


def _turned(one: Column, two: Column) -> list[Column]:
    """Two places (_key, _hash, position) as a match, the smaller document first."""
    less, more = F.least(one, two), F.greatest(one, two)
    return [
        less["_key"].alias("_key"), less["_hash"].alias("_hash"), more["_key"].alias("other_key"),
        more["_hash"].alias("other_hash"), less["position"].alias("position"), more["position"].alias("other"),
    ]


def _matches(shared: DataFrame, hashed: DataFrame) -> DataFrame:
    """(_key, _hash, other_key, other_hash, position, other, sure): places of seeds in two
    documents, the smaller one first; a sure match is a chain by itself."""
    many = shared.where(~F.col("few"))
    found = [
        _all_pairs(shared.where("few"), ["gram"], F.col("far")),
        _standing(many),
        _by_context(many, hashed),
    ]
    return functools.reduce(DataFrame.unionByName, found).select(*_MATCH)


_PAIR = ["_key", "_hash", "other_key", "other_hash"]
_CHAIN = "_key long, _hash long, other_key long, other_hash long, i int, j int, i_last int, j_last int"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair of documents; the matches of a pair come in a row."""
    names = [c.split()[0] for c in _CHAIN.split(", ")]
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> list[tuple]:
        sure = set(map(tuple, rows[rows[:, 6] == 1, 4:6].tolist()))
        if not sure and np.ptp(rows[:, 4]) + SEED_WORDS < _SPAN:
            return []
        # A match may have been found in several ways.
        rows = rows[np.append(True, (rows[1:, 4:6] != rows[:-1, 4:6]).any(1))]
        return [
            (*rows[0, :4].tolist(), a, b, c, d)
            for a, b, c, d in chains(rows[:, 4], rows[:, 5], SEED_WORDS, GAP_COST, SEED_WORDS)
            if min(c - a, d - b) + SEED_WORDS >= _SPAN or any(a <= i <= c and b <= j <= d for i, j in sure)
        ]

    def out(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.int32()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    for batch in batches:
        table = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in _MATCH], axis=1)
        if not len(table):
            continue
        table = np.concatenate([*held, table])
        starts = np.flatnonzero(np.append(True, (table[1:, :4] != table[:-1, :4]).any(1)))
        found = [x for s, e in zip(starts[:-1], starts[1:]) for x in solve(table[s:e])]
        held = [table[starts[-1] :]]
        if found:
            yield out(found)
    if held and (found := solve(held[0])):
        yield out(found)


_SLICE = (
    "_key long, _hash long, other_key long, other_hash long, i int, j int, side int, "
    "first int, words array<bigint>"
)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SLICE.split(", ")]
    for batch in batches:
        lists = batch.column("words")
        ends, words = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rows, size = [], 0
        for n, asked in enumerate(batch.column("asked")):
            text = words[ends[n] : ends[n + 1]]
            for ask in asked.as_py():
                first = max(0, ask["first"] - FLANK)
                cut = text[first : ask["last"] + SEED_WORDS + FLANK]
                rows.append((*(ask[c] for c in (*_PAIR, "i", "j", "side")), first, cut))
                size += len(cut)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_PASSAGE = (
    "_key long, other_key long, start int, end int, other_start int, other_end int, matches int"
)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the two slices of each chain, which come one after the other."""
    names = [c.split()[0] for c in _PASSAGE.split(", ")]
    types = [pa.int64()] * 2 + [pa.int32()] * 5
    waiting = None
    for batch in batches:
        found = []
        lists = batch.column("words")
        ends, words = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        columns = [batch.column(c).to_pylist() for c in (*_PAIR, "i", "j", "side", "first")]
        for n, (*chain, side, first) in enumerate(zip(*columns)):
            text = words[ends[n] : ends[n + 1]]
            if waiting is None or waiting[0] != chain or waiting[1] == side:
                waiting = chain, side, first, text
                continue
            _, _, a_first, a = waiting
            waiting = None
            start, end, other_start, other_end, matches = align(a, text, chain[4] - a_first, chain[5] - first)
            longer = max(end - start, other_end - other_start)
            if matches >= LEAST_WORDS and matches >= IDENTITY * longer:
                found.append(
                    (chain[0], chain[2], start + a_first, end + a_first, other_start + first, other_end + first, matches)
                )
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def shared_passages(docs: DataFrame) -> DataFrame:
    """Passages of at least ``LEAST_WORDS`` matching words that documents share: doc_id,
    start_word, end_word, other_id, other_start, other_end and matches, a row for either
    document.

    Words are runs of letters and digits with A-Z in lower case.  Up to a fifth of the words may
    differ, but a passage needs one seed, eight words in a row, that is equal in both: with a
    twentieth of the words changed nearly all are found, with a tenth nine of ten, with more
    ever fewer.  Of documents with a passage equal in all of them, each is linked to the first; where
    more than ``FEW`` documents hold every word that two share, they may be linked through others
    that hold the same words.  A null text
    has no words; rows that repeat an id with the same text are one document; a null id is
    null in the result.  Texts without a passage give no row, nor does an empty table.
    """
    spark = docs.sparkSession
    hashed = _hashed(docs)
    path = scratch_dir(spark, "seeds")
    found = hashed.mapInArrow(
        _seeds, "gram long, _key long, _hash long, position int, far int"
    )
    shared = written(found, "seeds", path)
    shared = written(_shared(shared), "shared-seeds")
    clear(spark, path)
    chained = written(
        _matches(shared, hashed)
        .repartition(*_PAIR)
        .sortWithinPartitions(*_PAIR, "position", "other")
        .mapInArrow(_chain, _CHAIN),
        "chains",
    ).dropDuplicates([*_PAIR, "i", "j"])
    common = [F.col(c).alias(c) for c in (*_PAIR, "i", "j")]
    asks = chained.select(
        F.explode(
            F.array(
                F.struct(F.col("_key").alias("k"), F.col("_hash").alias("h"), *common, F.lit(0).alias("side"),
                         F.col("i").alias("first"), F.col("i_last").alias("last")),
                F.struct(F.col("other_key").alias("k"), F.col("other_hash").alias("h"), *common, F.lit(1).alias("side"),
                         F.col("j").alias("first"), F.col("j_last").alias("last")),
            )
        ).alias("ask")
    )
    asks = written(asks, "slices-asked")
    # A document that stands for many is cut up in several copies.
    busy = written(
        asks.groupBy(F.col("ask.k").alias("k"), F.col("ask.h").alias("h"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > SLICES)
        .select("k", "h", F.ceil(F.col("n") / SLICES).cast("int").alias("copies")),
        "busy-documents",
    )
    copy = F.pmod(F.xxhash64("ask"), F.coalesce("copies", F.lit(1)))
    asked = (
        asks.select(F.col("ask.k").alias("k"), F.col("ask.h").alias("h"), "ask")
        .join(small(busy), ["k", "h"], "left")
        .groupBy(F.col("k").alias("_key"), F.col("h").alias("_hash"), copy.alias("copy"))
        .agg(F.collect_list("ask").alias("asked"))
        .select(*_ROW, "asked")
    )
    texts = with_row_key(pick(docs, "doc_id", "text")).dropDuplicates(_ROW).join(asked, _ROW)
    words = texts.select(F.transform(words_of("text"), lambda w: F.xxhash64(w)).alias("words"), "asked")
    order = [*_PAIR, "i", "j"]
    passages = written(
        words.mapInArrow(_slices, _SLICE)
        .repartition(*_PAIR)
        .sortWithinPartitions(*order, "side")
        .mapInArrow(_align, _PASSAGE)
        .distinct(),
        "passages",
    )
    known = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    one = passages.select(
        known("_key").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        known("other_key").alias("other_id"), "other_start", "other_end", "matches",
    )
    two = passages.select(
        known("other_key").alias("doc_id"), F.col("other_start").alias("start_word"),
        F.col("other_end").alias("end_word"), known("_key").alias("other_id"),
        F.col("start").alias("other_start"), F.col("end").alias("other_end"), "matches",
    )
    return one.unionByName(two).distinct()
