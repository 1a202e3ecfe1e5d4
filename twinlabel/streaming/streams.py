"""Structured Streaming forms.

Every sink writes one folder per micro-batch in overwrite mode, so a batch that
is replayed after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import PROVIDER_CODES
from ..operators.folds import latest_result
from ..operators.repeats import without_repeats
from ..operators.timeline import session_timeline
from ..plans.labelling import ClientFactory, label_two_stage
from ..session import children, path_exists, remove
from .stateful import KEPT, LATE, judged_requests, micros, session_states


AVAILABLE_NOW = {"availableNow": True}


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  partition_by: Iterable[str] = (),
                  trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Each micro-batch lands in ``path/batch=<n>``; by default all there is, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def label_stream(requests: DataFrame, packs: DataFrame, core: DataFrame,
                 factories: Mapping[str, ClientFactory], work: str, checkpoint: str,
                 max_clients: int | None = None,
                 trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Label requests as they arrive.

    Results and rejects land below ``work/out/batch=<n>/outcome=labelled`` and
    ``outcome=rejected``.  Replies are kept per batch: a replay finds the calls
    it has already paid for, and no batch reads the replies of all others.
    """

    def label(batch: DataFrame, number: int) -> None:
        results = label_two_stage(
            batch, packs, core, factories, f"{work}/replies/batch={number}", max_clients
        )
        outcome = F.when(F.col("status") == 200, "labelled").otherwise("rejected")
        (
            results.withColumn("outcome", outcome)
            .write.mode("overwrite")
            .partitionBy("outcome")
            .parquet(f"{work}/out/batch={number}")
        )

    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(label)
        .trigger(**trigger)
        .start()
    )


def _spans(spark, path: str) -> list[tuple[int, int]]:
    """Finished folders ``span=<first>-<last>`` of batches, those with most batches first."""
    names = [n.removeprefix("span=") for n in children(spark, path) if n.startswith("span=")]
    spans = [tuple(map(int, n.split("-"))) for n in names]
    done = [s for s in spans if path_exists(spark, f"{path}/span={s[0]}-{s[1]}/_SUCCESS")]
    return sorted(done, key=lambda s: (-s[1], s[0]))


def live_spans(spark, path: str, last: int | None = None) -> list[tuple[int, int]]:
    """The fewest folders that hold all batches up to ``last``, newest first."""
    live: list[tuple[int, int]] = []
    for first, end in _spans(spark, path):
        if (last is None or end <= last) and (not live or end == live[-1][0] - 1):
            live.append((first, end))
    return live


def _read_spans(spark, path: str, spans) -> DataFrame:
    return spark.read.parquet(*[f"{path}/span={first}-{last}" for first, last in spans])


def latest_result_stream(results: DataFrame, path: str, checkpoint: str,
                         keys=("image_id", "provider"), order=("ts", "request_id"),
                         trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Running newest result per image and provider, as a merge tree of folders below ``path``.

    A batch's newest rows are merged with those of the batches before it as a binary counter
    carries: batch n, counted from one, ends a folder over as many batches as the greatest power of two that
    divides n.  So a row is rewritten once per level, there are at most log2(n) + 1 folders, and
    the query itself keeps no state.  A replayed batch finds the folders it was made of, as they
    go only when the next batch begins, and replaces its own output.
    """
    keys, order = list(keys), list(order)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = live_spans(spark, path, number - 1)
        for first, last in _spans(spark, path):
            if last < number and (first, last) not in before:
                remove(spark, f"{path}/span={first}-{last}")
        width = (number + 1) & -(number + 1)
        merged = [s for s in before if s[0] > number - width]
        rows = batch
        if merged:
            rows = batch.unionByName(_read_spans(spark, path, merged).select(batch.columns))
        newest = latest_result(rows, keys, order)
        newest.write.mode("overwrite").parquet(f"{path}/span={number - width + 1}-{number}")

    return (
        results.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def read_latest(spark, path: str, keys=("image_id", "provider"), order=("ts", "request_id"),
                ) -> DataFrame:
    """The current newest rows from the folders ``latest_result_stream`` keeps."""
    return latest_result(_read_spans(spark, path, live_spans(spark, path)), keys, order)


def drop_duplicate_requests(requests: DataFrame, path: str, checkpoint: str,
                            key: Iterable[str] = ("request_key",), ts: str = "ts",
                            order: Iterable[str] = ("request_id",), within: str = "10 minutes",
                            late: str = "1 day", trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Judge requests as they arrive; they land below ``path`` with their ``outcome``, see
    :func:`twinlabel.streaming.stateful.judged_requests`.  None is lost."""
    judged = judged_requests(requests, key, ts, order, within, late)
    return write_batches(judged, path, checkpoint, partition_by=["outcome"], trigger=trigger)


def kept_requests(spark, path: str, key: Iterable[str] = ("request_key",), ts: str = "ts",
                  order: Iterable[str] = ("request_id",), within: str = "10 minutes") -> DataFrame:
    """The requests to keep out of what ``drop_duplicate_requests`` landed.

    Where no request of a key was late, those that the stream kept; the keys of late requests
    are judged anew over all their requests, which gives what a batch over all would give.
    """
    keys, order = list(key), list(order)
    landed = spark.read.parquet(path).select(*keys, *order, ts, "outcome")
    name = F.to_json(F.struct(*keys))
    behind = landed.where(F.col("outcome") == LATE).select(name.alias("_late")).distinct()
    on = name == F.col("_late")
    settled = landed.where(F.col("outcome") == KEPT).join(behind, on, "left_anti")
    again = without_repeats(landed.join(behind, on, "left_semi"), keys, ts, order, micros(within))
    return settled.drop("outcome").unionByName(again)


def _newest(condition: Column, order: Column, value: Column) -> Column:
    return F.max(F.when(condition, F.struct(order.alias("at"), value.alias("v"))))


def session_fold(events: DataFrame, providers=PROVIDER_CODES, session: str = "session_id",
                 image: str = "image_seq", provider: str = "provider", kind: str = "kind",
                 order=("ts", "event_id"), result: str = "result", error: str = "error",
                 ) -> DataFrame:
    """State per session: newest image and, for that image, result and error per provider.

    The fold orders events by (image, ts, id), so it is an ordinary aggregate:
    late and unordered events need no buffering, and a hot session is combined
    in the map tasks.  Works on a batch and, in update mode, on a stream, where
    a session's state is emitted after every trigger that touched it.
    """
    at = F.struct(image, *order)
    picks = [F.max(image).alias("image")]
    for p in providers:
        mine = F.col(provider) == p
        picks.append(
            _newest(mine & (F.col(kind) == "ok"), at, F.col(result)).alias(f"{p}_result")
        )
        shown = F.when(F.col(kind) == "error", F.col(error))
        picks.append(
            _newest(mine & F.col(kind).isin("start", "error"), at, shown).alias(f"{p}_error")
        )
    folded = events.groupBy(session).agg(*picks)
    live = [
        F.when(F.col(c)["at"][image] == F.col("image"), F.col(c)["v"]).alias(c)
        for c in folded.columns
        if c not in (session, "image")
    ]
    return folded.select(session, "image", *live)


def read_session_states(spark, path: str, session: str = "session_id") -> DataFrame:
    """Newest state per session from the batches written in update mode.

    Each update replaces the session's earlier one, so the last batch counts.
    """
    written = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in written.columns if c not in (session, "batch")]
    return (
        written.groupBy(session)
        .agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        .select(session, "_row.*")
    )


def session_state_stream(events: DataFrame, path: str, checkpoint: str, providers=PROVIDER_CODES,
                         late: str = "1 hour", idle: str | None = None,
                         trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """State of every session after each event, landed below ``path`` as the watermark passes
    the events; see :func:`twinlabel.streaming.stateful.session_states`."""
    states = session_states(events, providers, late, idle)
    return write_batches(states, path, checkpoint, partition_by=["outcome"], trigger=trigger)


def settled_timeline(landed: DataFrame, events: DataFrame, providers=PROVIDER_CODES) -> DataFrame:
    """What ``session_state_stream`` landed, with the sessions of late events folded anew over
    all their events by the batch operator."""
    behind = landed.where(F.col("outcome") == LATE).select(F.col("session_id").alias("_late")).distinct()
    on = F.col("session_id").eqNullSafe(F.col("_late"))
    settled = landed.where(F.col("outcome") == KEPT).join(behind, on, "left_anti")
    again = session_timeline(events.join(behind, on, "left_semi"), providers)
    return settled.select(again.columns).unionByName(again)
