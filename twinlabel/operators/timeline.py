"""What a session shows after each of its events.

A running fold over a session is sequential, and one session may hold a third
of all events.  So the ordered events are cut into chunks, each chunk is folded
on its own, and what earlier chunks leave behind is carried in from one summary
row per chunk.  Windows only ever run inside a chunk or over chunk summaries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PROVIDER_CODES
from ..session import scratch_dir

# Events of a chunk at most, on average.
CHUNK_EVENTS = 2_000_000
EVENT_COLUMNS = ("session_id", "image_seq", "provider", "kind", "ts", "event_id", "result", "error")


def chunked(events: DataFrame, chunks: int | None = None) -> DataFrame:
    """Events with ``chunk``, ascending along (session, ts, id); written out once.

    Range bounds come from a sample, so the cut is fixed by writing it: a lost
    executor can then never mix two cuts.
    """
    spark = events.sparkSession
    width = chunks or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(events.count() / CHUNK_EVENTS),
    )
    path = scratch_dir(spark, "timeline")
    (
        events.select(*EVENT_COLUMNS)
        .repartitionByRange(width, "session_id", "ts", "event_id")
        .withColumn("chunk", F.spark_partition_id())
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def _columns(providers) -> dict[str, tuple[str, Column]]:
    """Per state column: the provider it belongs to and what an event sets it to.

    Wrapped in a struct, so that "set to nothing" differs from "not touched".
    """
    live = F.col("image_seq") == F.col("image")
    out = {}
    for p in providers:
        mine = live & (F.col("provider") == p)
        out[f"{p}_result"] = F.when(
            mine & (F.col("kind") == "ok"), F.struct(F.col("result").alias("v"))
        )
        out[f"{p}_error"] = F.when(
            mine & F.col("kind").isin("start", "error"),
            F.struct(F.when(F.col("kind") == "error", F.col("error")).alias("v")),
        )
    return out


def session_timeline(events: DataFrame, providers=PROVIDER_CODES,
                     chunks: int | None = None) -> DataFrame:
    """session_id, event_id, image, and per provider ``<p>_result`` and ``<p>_error``.

    The image in effect is the newest seen so far; a newer one resets
    everything, and events of an older one change nothing.
    """
    cut = chunked(events, chunks)
    at = [F.col("ts"), F.col("event_id")]
    in_chunk = Window.partitionBy("session_id", "chunk").orderBy(*at)
    before = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    seen = (
        cut.groupBy("session_id", "chunk")
        .agg(F.max("image_seq").alias("_top"))
        .select("session_id", "chunk", F.max("_top").over(before).alias("_seen"))
    )
    imaged = (
        cut.join(seen, ["session_id", "chunk"], "left")
        .withColumn("image", F.greatest("_seen", F.max("image_seq").over(in_chunk)))
        .drop("_seen")
    )

    sets = _columns(providers)
    touched = imaged.withColumns(sets)
    keys = ["session_id", "image", "chunk"]
    order = F.struct("ts", "event_id")
    ends = touched.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in sets]
    )
    earlier = Window.partitionBy("session_id", "image").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = ends.select(
        *keys, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in sets]
    )
    running = Window.partitionBy(*keys).orderBy(*at).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return touched.join(carried, keys, "left").select(
        "session_id",
        "event_id",
        "image",
        *[
            F.coalesce(F.last(c, ignorenulls=True).over(running), F.col(f"_{c}"))["v"].alias(c)
            for c in sets
        ],
    )
