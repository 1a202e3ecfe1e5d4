"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are dealt into blocks.  With weight w, block i of a source is released
at slot floor(i / w) and due by slot ceil((i + 1) / w); in every slot the released block that
is due first goes next.  As the weights sum to one, every block meets its due time, so after
any number of slots no source is a whole block ahead of or behind its weight.

Until the first source runs out, the slots are laid out one after the other from weights in
parts of ``GRAIN``, so fine that rounding is far below a block over any number of slots.  One
task writes them, a row per block, and holds no more than one block per source.  What is left
then can meet no target; it follows in periods of ``RESOLUTION`` slots with whole weights, and
the slot of any such block follows from its number by arithmetic.

Rows get their number inside their
source from counts per (source, bucket) and a rank inside the bucket, so a source with a
third of all rows is spread over as many buckets as any amount of rows needs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small, written

GRAIN = 2**62
RESOLUTION = 1000
BLOCK_ROWS = 16
# Slots laid out in one batch.
LAYOUT_ROWS = 10_000
# Source shares are raised to this power, which lifts small sources.
TEMPERATURE = 0.5
# Rows meant for one bucket of a source.
BUCKET_ROWS = 50_000
MAX_SOURCES = 100_000


def period(weights: list[int]) -> list[tuple[int, int]]:
    """(source, block of that source) per slot of one period of ``sum(weights)`` slots.

    Of blocks due at the same time the one of the earlier source goes first.
    """
    slots = sum(weights)
    waiting = [(0, source, 0) for source, weight in enumerate(weights) if weight]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    plan = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, source, block = heapq.heappop(waiting)
            due = -(-(block + 1) * slots // weights[source])
            heapq.heappush(ready, (due, source, block))
        due, source, block = heapq.heappop(ready)
        if slot >= due:
            raise ArithmeticError("a block would miss its due time")
        plan.append((source, block))
        if block + 1 < weights[source]:
            heapq.heappush(waiting, ((block + 1) * slots // weights[source], source, block + 1))
    return plan


def fine_weights(shares: list[float]) -> list[int]:
    """Shares in parts of ``GRAIN``, their sum; none for a share of zero, one at least else."""
    total = math.fsum(shares)
    if not total:
        shares, total = [1.0] * len(shares), float(len(shares))
    weights = [max(1, int(share / total * GRAIN)) if share > 0 else 0 for share in shares]
    weights[weights.index(max(weights))] += GRAIN - sum(weights)
    return weights


def schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) per slot until a source with no block left would be next."""
    total = sum(weights)
    waiting = [(0, source, 0) for source, weight in enumerate(weights) if weight]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[source]), source, block))
        due, source, block = heapq.heappop(ready)
        if slot >= due:
            raise ArithmeticError("a block would miss its due time")
        if block >= blocks[source]:
            return
        yield source, block
        heapq.heappush(waiting, ((block + 1) * total // weights[source], source, block + 1))
        slot += 1


def whole_weights(shares: list[float], resolution: int = RESOLUTION) -> list[int]:
    """Shares as whole numbers of at least one that sum to ``resolution``, or to the number
    of sources if that is more, by largest remainders."""
    slots = max(resolution, len(shares))
    total = math.fsum(shares)
    exact = [(share / total if total else 1 / len(shares)) * slots for share in shares]
    weights = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(shares)), key=lambda i: (math.floor(exact[i]) - exact[i], i))
    for i in order[: max(0, slots - sum(weights))]:
        weights[i] += 1
    # What the sources raised to one slot have taken comes off the largest.
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    for _ in range(sum(weights) - slots):
        w, i = heap[0]
        weights[i] -= 1
        heapq.heapreplace(heap, (w + 1, i))
    return weights


def _numbered(docs: DataFrame, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their number inside their source, in the order of a hash of the id; and the
    number of rows per source."""
    rows = pick(docs, "doc_id", "source", carry=carry)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.withColumns(
        {
            "_mark": F.xxhash64("doc_id"),
            "_bucket": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)).cast("int"),
        }
    )
    counts = written(rows.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        counts.select(
            "source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
        ),
        "bucket-offsets",
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_mark", "doc_id")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    offsets = offsets.select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_before"
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))
    numbered = ranked.join(small(offsets), same).withColumn("_number", F.col("_before") + F.col("_rank"))
    return numbered, counts.groupBy("source").agg(F.sum("n").alias("n"))


def _scheduled(docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, carry: bool) -> DataFrame:
    spark = docs.sparkSession
    numbered, sizes = _numbered(docs, carry)
    found = sizes.orderBy(F.col("source").asc_nulls_first()).take(MAX_SOURCES + 1)
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [r["source"] for r in found]
    if weights is None:
        shares = [r["n"] ** TEMPERATURE for r in found]
    else:
        shares = [float(weights.get(name, 0.0)) for name in names]
    blocks = [-(-r["n"] // block_rows) for r in found]
    fine = fine_weights(shares) if names else []

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            slots = enumerate(schedule(fine, blocks))
            while part := list(islice(slots, LAYOUT_ROWS)):
                columns = zip(*[(source, block, slot) for slot, (source, block) in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["_source", "_nth", "_slot"]
                )

    layout = written(
        spark.range(0, 1, 1, 1).mapInArrow(lay_out, "_source long, _nth long, _slot long"), "slots"
    )
    horizon = layout.count()
    taken = {
        r["_source"]: r["n"]
        for r in layout.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).take(MAX_SOURCES)
    }
    # The slots after those, for sources that have a weight.
    given = [source for source, weight in enumerate(fine) if weight]
    whole = dict(zip(given, whole_weights([fine[source] for source in given]))) if given else {}
    slots = sum(whole.values())
    tail = spark.createDataFrame(
        [(given[at], block, slot) for slot, (at, block) in enumerate(period(list(whole.values())))],
        "_t long, _t_nth long, _t_slot long",
    )
    per_source = spark.createDataFrame(
        [(name, source, taken.get(source, 0), whole.get(source)) for source, name in enumerate(names)],
        "_s string, _at long, _taken long, _w long",
    )
    rows = numbered.drop("_source", "_b").withColumn("block", F.floor(F.col("_number") / block_rows))
    rows = rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_after", F.col("block") - F.col("_taken")
    )
    rows = rows.join(
        small(layout), (F.col("_at") == F.col("_source")) & (F.col("block") == F.col("_nth")), "left"
    ).join(
        F.broadcast(tail),
        (F.col("_at") == F.col("_t")) & (F.col("_after") % F.col("_w") == F.col("_t_nth")),
        "left",
    )
    later = horizon + F.floor(F.col("_after") / F.col("_w")) * slots + F.col("_t_slot")
    slot = F.coalesce("_slot", later).cast("long")
    return rows.select(
        *(["_row"] if carry else []),
        "doc_id",
        "source",
        F.col("block").cast("long").alias("block"),
        slot.alias("slot"),
        (F.col("_number") % block_rows).cast("int").alias("place"),
        F.col("_slot").isNotNull().alias("on_target"),
    )


def mixed(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per document: its source, block of the source, slot of the block in the mix, place in
    the block, and on_target, whether the slot lies before the first source ran out.

    Reading by slot and place mixes the sources.  No row is left out or repeated: after a
    source has run out its slots stay empty, and weights are rounded to whole ones.
    ``weights`` are shares per source, by default its number of rows to the power
    ``TEMPERATURE``; rows of a source without a weight, or with weight zero, have no slot,
    unless no source has any, which makes them equal.  A null source is a source of its own; documents with a null id come first in
    it or in their bucket.  An empty table gives no rows.
    """
    return _scheduled(docs, weights, block_rows, carry=False)


def mixed_rows(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The rows of ``docs`` with block, slot, place and on_target, named ``mix_*``."""
    rows = _scheduled(docs, weights, block_rows, carry=True)
    names = docs.columns
    return rows.select(
        *[F.col(f"_row._c{i}").alias(name) for i, name in enumerate(names)],
        *[F.col(name).alias(f"mix_{name}") for name in ("block", "slot", "place", "on_target")],
    )
