"""Removal of long repeated byte strings with sharded suffix arrays.

A suffix array of the whole corpus does not fit anywhere, so it is cut by content.  In a
string of ``LEAST`` bytes the gram of ``GRAM`` bytes with the smallest hash stands at the
same offset wherever the string stands; grams so chosen are about one in 170 bytes.
Neighbouring strings that choose the same gram form a run, and equal strings are always in
runs with the same gram.  So:

1. every run is listed with its gram and a digest of its bytes, a narrow table;
2. runs whose bytes occur twice repeat as a whole; grams that stand before different bytes
   need a closer look, at one run for each of the different contents;
3. those runs are cut out of their texts, dealt by gram, and an enhanced suffix array over
   the runs of some grams at a time gives their maximal repeats.

A gram with more than ``GROUP_RUNS`` different runs is not gathered in one place.  Its runs
are cut into blocks of neighbouring starts, aligned at the gram, and dealt by the bytes that
all strings of a block share.  Blocks of equal bytes repeat as a whole.  Only where blocks
share those bytes and still differ, at the edges of a passage, are their strings dealt one by
one, by their own digest; that splits the group exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chaining import sliding_min
from .common import pick, with_row_key, written
from .suffix_array import longest_repeats

LEAST = 400
GRAM = 64
GROUP_RUNS = 1000
# Neighbouring starts of a block.
_BLOCK_STARTS = 42
# Bytes that are hashed together, and bytes of one suffix array.
_PIECE = 1 << 18
_ARRAY_BYTES = 1 << 20
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of every ``GRAM`` bytes, by doubling."""
    value, factor, length = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while length < GRAM:
        value = value[:-length] * np.uint64(factor) + value[length:]
        factor, length = factor * factor % 2**64, 2 * length
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    return value


def _runs_of(data: np.ndarray, ends: np.ndarray, least: int):
    """(start, count, gram) of the runs in texts laid end to end, ``ends`` where each ends."""
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = _gram_hashes(data)
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(keyed, least - GRAM + 1) & _PLACE).astype(np.int64)
    starts = np.arange(len(chosen))
    text = np.searchsorted(ends, starts, side="right")
    valid = starts + least <= ends[text]
    place, kept = np.where(valid, chosen, -1), starts[valid]
    if not len(kept):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    fresh = valid & np.concatenate([[True], (place[1:] != place[:-1])])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(np.searchsorted(kept, first), len(kept)))
    return first, count, grams[place[first]]


def _pieces(texts: list[bytes], least: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts laid end to end in pieces of bounded size, with (row, start in the text, end in
    the piece).  A long text is cut into pieces that share ``least - 1`` bytes."""
    held: list[bytes] = []
    marks: list[tuple[int, int, int]] = []
    size = 0
    for row, text in enumerate(texts):
        if len(text) < least:
            continue
        for at in range(0, max(1, len(text) - least + 1), _PIECE - least + 1):
            part = text[at : at + _PIECE]
            if size + len(part) > _PIECE and held:
                yield b"".join(held), marks
                held, marks, size = [], [], 0
            held.append(part)
            size += len(part)
            marks.append((row, at, size))
    if held:
        yield b"".join(held), marks


def _list_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, code = batch.column("_key").to_numpy(), batch.column("_hash").to_numpy()
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for data, marks in _pieces(batch.column("text").cast(pa.binary()).to_pylist(), least):
                ends = np.array([end for _, _, end in marks])
                first, count, gram = _runs_of(np.frombuffer(data, np.uint8), ends, least)
                text = np.searchsorted(ends, first, side="right")
                row = np.array([m[0] for m in marks])[text]
                shift = np.array([m[1] for m in marks]) - np.append(0, ends[:-1])
                digest = xxhash.xxh3_64_intdigest
                content = [
                    digest(data[s : s + n - 1 + least]) for s, n in zip(first.tolist(), count.tolist())
                ]
                for into, values in zip(
                    columns,
                    (
                        gram.view(np.int64),
                        np.array(content, dtype=np.uint64).view(np.int64),
                        key[row],
                        code[row],
                        first + shift[text],
                        count,
                    ),
                ):
                    into.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in columns],
                    names=["gram", "content", "_key", "_hash", "start", "count"],
                )

    return run


def _blocks(piece: bytes, gram: int, count: int, least: int) -> Iterator[tuple]:
    """(core, content, first start, starts, digests) of the blocks of a run's starts."""
    hashes = _gram_hashes(np.frombuffer(piece, np.uint8)).view(np.int64)
    # The gram that all strings hold; of equal ones the first was chosen.
    place = count - 1 + int((hashes[count - 1 : least - GRAM + 1] == gram).argmax())
    digest = xxhash.xxh3_64_intdigest
    end = count
    while end > 0:
        # Block of the string that starts just before ``end``, by its distance to the gram.
        block = (place - end + 1) // _BLOCK_STARTS
        start = max(0, place - (block + 1) * _BLOCK_STARTS + 1)
        core = piece[place - block * _BLOCK_STARTS : place - (block + 1) * _BLOCK_STARTS + 1 + least]
        yield (
            digest(core, block) - 2**63,
            digest(piece[start : end - 1 + least], place - start) - 2**63,
            start,
            end - start,
            [digest(piece[s : s + least]) - 2**63 for s in range(start, end)],
        )
        end = start


def _cut(least: int):
    """Cuts the asked runs out of their texts; those of large groups become blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _CUT_SCHEMA.names
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out: list[list] = [[] for _ in names]
            size = 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                key, code = batch.column("_key")[i].as_py(), batch.column("_hash")[i].as_py()
                for ask in batch.column("asked")[i].as_py():
                    start, count = ask["start"], ask["count"]
                    piece = text[start : start + count - 1 + least]
                    if ask["large"]:
                        rows = [
                            (core, content, start + s, n, digests, None)
                            for core, content, s, n, digests in _blocks(piece, ask["gram"], count, least)
                        ]
                    else:
                        rows = [(None, None, start, count, None, piece)]
                    for core, content, s, n, digests, piece in rows:
                        values = (ask["large"], ask["gram"], core, content, ask["times"], key, code, s, n)
                        for into, value in zip(out, (*values, digests, piece)):
                            into.append(value)
                        size += len(piece or b"") + 8 * len(digests or ()) + 64
                    if size > 8 << 20:
                        yield _batch(out)
                        out, size = [[] for _ in names], 0
            if out[0]:
                yield _batch(out)

    return run


_CUT = (
    "large boolean, gram long, core long, content long, times long, _key long, _hash long, "
    "start long, count long, digests array<long>, bytes binary"
)
_CUT_SCHEMA = pa.schema(
    [
        ("large", pa.bool_()),
        *[(n, pa.int64()) for n in ("gram", "core", "content", "times", "_key", "_hash", "start", "count")],
        ("digests", pa.list_(pa.int64())),
        ("bytes", pa.binary()),
    ]
)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _CUT_SCHEMA)], schema=_CUT_SCHEMA
    )


def _of_large_groups(cut: DataFrame, least: int) -> DataFrame:
    """(length, _key, _hash, start): repeated spans among the blocks of large groups."""
    blocks = cut.where("large")
    place = F.struct("_key", "_hash", "start", "digests")
    kinds = written(
        blocks.groupBy("gram", "core", "content").agg(
            F.sum("times").alias("times"), F.first(place).alias("one")
        ),
        "block-contents",
    )
    whole = blocks.join(
        kinds.where("times > 1").select("gram", "core", "content"), ["gram", "core", "content"]
    ).select((F.col("count") - 1 + least).alias("length"), "_key", "_hash", "start")
    several = kinds.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    strings = (
        kinds.join(several, ["gram", "core"])
        .select("gram", "times", "one._key", "one._hash", "one.start", F.posexplode("one.digests"))
        .select(
            "gram", F.col("col").alias("digest"), "times", "_key", "_hash",
            (F.col("start") + F.col("pos")).alias("start"),
        )
    )
    again = strings.groupBy("gram", "digest").agg(F.sum("times").alias("n")).where("n > 1")
    # What repeats as a block is listed already.
    single = strings.where("times = 1").join(again.select("gram", "digest"), ["gram", "digest"])
    return whole.unionByName(
        single.select(F.lit(least).cast("long").alias("length"), "_key", "_hash", "start")
    )


def _search(least: int):
    """Spans that maximal repeats cover in the runs of each gram; all runs of a gram come in
    a row."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        _, length, string, offset = longest_repeats([r[3] for r in rows], least)
        # Occurrences inside one run overlap heavily; a run gives the spans they cover.
        order = np.lexsort((offset, string))
        string, offset, end = string[order], offset[order], (offset + length)[order]
        # Ends so far, run by run: a run's own are lifted above those of the runs before.
        lift = string * (1 << 32)
        reached = np.maximum.accumulate(end + lift)
        fresh = np.append(True, (offset + lift)[1:] > reached[:-1])[: len(string)]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(string)) - 1
        run_of, start = string[first], offset[first]
        size = reached[last] - lift[last] - start
        column = lambda i: np.array([r[i] for r in rows], dtype=np.int64)[run_of]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (size, column(0), column(1), column(2) + start)],
            names=["length", "_key", "_hash", "start"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, cut = 0, None, 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("gram", "_key", "_hash", "start", "bytes")]
            for gram, key, code, start, piece in zip(*columns):
                if gram != last:
                    if size > _ARRAY_BYTES:
                        yield solve(rows)
                        rows, size = [], 0
                    last = gram
                rows.append((key, code, start, piece))
                size += len(piece)
        if rows:
            yield solve(rows)

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(length, _key, _hash, start): spans of a text that strings of ``least`` bytes cover
    which also start elsewhere.

    Every span comes from one run, so that what is long comes as overlapping parts.
    """
    texts = with_row_key(pick(docs, "doc_id", "text")).select(
        "_key", "_hash", F.coalesce("text", F.lit("")).alias("text")
    )
    runs = written(
        texts.mapInArrow(
            _list_runs(least),
            "gram long, content long, _key long, _hash long, start long, count long",
        ),
        "runs",
    )
    one = F.struct("_key", "_hash", "start", "count")
    contents = written(
        runs.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("times"), F.first(one).alias("one")),
        "run-contents",
    )
    several = contents.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    whole = runs.join(contents.where("times > 1").select("gram", "content"), ["gram", "content"]).select(
        (F.col("count") - 1 + least).alias("length"),
        "_key",
        "_hash",
        "start",
    )
    asked = (
        contents.join(several, "gram")
        .select("one.*", "gram", "times", (F.col("kinds") > group_runs).alias("large"))
        .groupBy("_key", "_hash")
        .agg(F.collect_list(F.struct("start", "count", "gram", "times", "large")).alias("asked"))
    )
    cut = written(texts.join(asked, ["_key", "_hash"]).mapInArrow(_cut(least), _CUT), "cut-runs")
    arrays = (
        cut.where("not large")
        .select("gram", "_key", "_hash", "start", "bytes")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_search(least), "length long, _key long, _hash long, start long")
    )
    return whole.unionByName(arrays).unionByName(_of_large_groups(cut, least))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
            data, kept, removed, number, at = text.as_py(), hashlib.sha256(), 0, 0, 0
            for start, end in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                if start > at or not number:
                    number += 1
                    kept.update(data[at:start])
                    at = start
                removed += max(0, end - at)
                at = max(at, end)
            kept.update(data[at:])
            for into, value in zip(out, (len(data), removed, number, kept.hexdigest())):
                into.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def without_repeats(docs: DataFrame, least: int = LEAST, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256 after removing every byte
    inside a string of ``least`` bytes that also starts anywhere else.

    A null text is empty; texts shorter than ``least`` keep all.  A row that is repeated
    repeats all its strings.  An empty table gives no rows.
    """
    spans = (
        repeated_spans(docs, least, group_runs)
        .select("_key", "_hash", "start", (F.col("start") + F.col("length")).alias("end"))
        .groupBy("_key", "_hash", "start")
        .agg(F.max("end").alias("end"))
        .groupBy("_key", "_hash")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    rows = with_row_key(pick(docs, "doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    return (
        rows.join(spans, ["_key", "_hash"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        )
    )
