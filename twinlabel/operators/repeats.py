"""Repeats of a request within a time bound, exactly, for any number of requests per key.

Requests are judged in order of time: the first of a key is kept, then the first that is at
least the bound after the last kept one, and so on.  That is a chain, and one key may hold a
third of all requests.  So the points in time are cut into ordered chunks; a chunk says, as a
step function, which last kept time it hands on for the one it is given; following the chunks of
a key gives each its entry, and then all chunks mark their kept points side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

# Points of a chunk, which one task holds at a time.
CHUNK_POINTS = 1_000_000


def _links(at: np.ndarray, within: int) -> np.ndarray:
    """Per point the first one that is not within the bound after it, or their number."""
    return np.searchsorted(at, at + within, side="left")


def _handed_on(at: np.ndarray, within: int) -> tuple[list[int], list[int]]:
    """Starts and last kept times: an entry that allows requests from a time on has the last kept
    time that stands at the first start not before it."""
    links = _links(at, within)
    last = np.arange(len(at))
    for i in range(len(at) - 1, -1, -1):
        if links[i] < len(at):
            last[i] = last[links[i]]
    # An earlier request lies before the first point, so it bars less than one bound after it.
    reach = min(len(at) - 1, int(links[0]))
    exits = at[last[: reach + 1]]
    steps = np.append(np.flatnonzero(exits[1:] != exits[:-1]), reach)
    return at[steps].tolist(), exits[steps].tolist()


def _marked(at: np.ndarray, within: int, entry: int | None) -> np.ndarray:
    kept = np.zeros(len(at), dtype=bool)
    links = _links(at, within)
    i = 0 if entry is None else int(np.searchsorted(at, entry + within, side="left"))
    while i < len(at):
        kept[i] = True
        i = links[i]
    return kept


def without_repeats(requests: DataFrame, key: Iterable[str], ts: str, order: Iterable[str],
                    within_micros: int, chunks: int | None = None) -> DataFrame:
    """The kept requests: columns of ``key``, ``order`` and ``ts``.

    A request is left out if it is less than the bound after the last kept one of its key.  Of
    requests at one time the first in ``order`` counts.  A null in the key is a value of its own;
    requests without a time are all kept.  No requests give no rows.
    """
    keys, order = list(key), list(order)
    spark = requests.sparkSession
    rows = requests.select(
        F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])).alias("name"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.struct(*keys).alias("key"),
        F.struct(*order).alias("order"),
    )
    undated = rows.where(F.col("at").isNull()).select("key", "order", "at")
    # Requests at one time are one point, however many there are.
    points = f"{scratch_dir(spark, 'repeats')}/points"
    (
        rows.where(F.col("at").isNotNull())
        .groupBy("name", "at")
        .agg(F.first("key").alias("key"), F.min("order").alias("order"))
        .write.parquet(points)
    )
    found = spark.read.parquet(points)
    width = chunks or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(found.count() / CHUNK_POINTS),
    )
    cut_path = f"{points}-cut"
    (
        found.repartitionByRange(width, "name", "at")
        .withColumn("chunk", F.spark_partition_id())
        .write.parquet(cut_path)
    )
    cut = spark.read.parquet(cut_path)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        # Only the first and the last key of a chunk can stand in others too.
        ends = sorted({part["name"].min(), part["name"].max()})
        out = []
        for name in ends:
            at = np.sort(part.loc[part["name"] == name, "at"].to_numpy())
            out.append((name, int(part["chunk"].iloc[0]), *_handed_on(at, within_micros)))
        return pd.DataFrame(out, columns=["name", "chunk", "starts", "exits"])

    def entries(part: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for row in part.sort_values("chunk").itertuples():
            if last is not None:
                out.append((row.name, row.chunk, last))
            step = 0 if last is None else int(np.searchsorted(row.starts, last + within_micros))
            if step < len(row.exits):
                last = int(row.exits[step])
        return pd.DataFrame(out, columns=["name", "chunk", "entry"])

    def mark(part: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return part.assign(kept=False)[["name", "at", "kept"]]
        part = part.sort_values(["name", "at"], kind="stable")
        entry = dict(zip(given["name"], given["entry"]))
        at = part["at"].to_numpy()
        names = part["name"].to_numpy()
        bounds = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        kept = np.concatenate([
            _marked(at[a:b], within_micros, entry.get(names[a])) for a, b in zip(bounds, bounds[1:])
        ])
        return part.assign(kept=kept)[["name", "at", "kept"]]

    narrow = cut.select("name", "at", "chunk")
    ends = narrow.groupBy("chunk").applyInPandas(
        summary, "name string, chunk int, starts array<long>, exits array<long>"
    )
    given = ends.groupBy("name").applyInPandas(entries, "name string, chunk int, entry long")
    marks = (
        narrow.groupBy("chunk")
        .cogroup(given.groupBy("chunk"))
        .applyInPandas(mark, "name string, at long, kept boolean")
        .where("kept")
    )
    kept = cut.join(marks, ["name", "at"], "left_semi").select("key", "order", "at")
    return kept.unionByName(undated).select(
        "key.*", "order.*", F.timestamp_micros("at").alias(ts)
    )
