"""Streaming forms, run over everything available and read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel.operators.repeats import without_repeats
from twinlabel.session import scratch_dir
from twinlabel.streaming.stateful import micros
from twinlabel.streaming.streams import (
    drop_duplicate_requests,
    kept_requests,
    label_stream,
    latest_result_stream,
    read_latest,
    read_session_states,
    session_fold,
    session_state_stream,
    settled_timeline,
    write_batches,
)

from .bindings import (
    STUB_RESULT_SQL,
    as_requests,
    as_session_events,
    core_text,
    packs,
    session_events,
    stub_clients,
)
from .comparison_queries import SESSION_STATE_SQL
from .registry import ORACLE, query, table


def stream_table(spark, sf_dir, name):
    """The table as a stream; the glob fits a single file and a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def in_parts(spark, rows, parts, of, run):
    """Let ``rows`` arrive in ``parts`` steps: ``of`` numbers the step of a row, and after each one
    ``run(folder)`` resumes a stream over all that has arrived."""
    folder = f"{scratch_dir(spark, 'arrivals')}/in"
    for part in range(parts):
        rows.where(of == part).write.mode("append").parquet(folder)
        run(folder)
    return folder


def step_of_time(rows, ts, parts, delay=0):
    """Number of the equal range of time that a row falls into, between the least and the
    greatest time of the table; ``delay`` seconds late."""
    ends = rows.agg(F.min(F.unix_micros(ts)).alias("a"), F.max(F.unix_micros(ts)).alias("b")).first()
    start, end = ends["a"] or 0, ends["b"] or 0
    step = F.floor((F.unix_micros(ts) - start + delay * 1_000_000) * parts / max(1, end - start))
    return F.greatest(F.lit(0), F.least(step, F.lit(parts - 1)))


@query(ORACLE["latest_result"])
def stream_latest(spark, sf_dir):
    """Running newest value per user and event type, over five micro-batches in no order of
    time, merged as they come."""
    work = scratch_dir(spark, "stream-latest")
    events = table(spark, sf_dir, "events").drop("props")
    keys, order = ("user_id", "event_type"), ("ts", "event_id")

    def run(folder):
        arrived = spark.readStream.schema(events.schema).parquet(folder)
        latest_result_stream(
            arrived, f"{work}/out", f"{work}/checkpoint", keys, order
        ).awaitTermination()

    in_parts(spark, events, 5, F.col("event_id") % 5, run)
    return read_latest(spark, f"{work}/out", keys, order).select(*keys, "event_id", "value")


# Of a key's requests the first, and then each time the first at least an hour after the last.
REPEATS_SQL = """
  WITH RECURSIVE p AS (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events
                       GROUP BY ALL),
  n AS (SELECT p.*, q.ts AS onward FROM p ASOF LEFT JOIN p AS q
        ON p.user_id = q.user_id AND p.event_type = q.event_type
           AND p.ts + INTERVAL 1 HOUR <= q.ts),
  k AS (SELECT n.* FROM n JOIN (SELECT user_id, event_type, min(ts) AS ts FROM p GROUP BY ALL)
        USING (user_id, event_type, ts)
        UNION ALL
        SELECT n.* FROM k JOIN n ON n.user_id = k.user_id AND n.event_type = k.event_type
                                AND n.ts = k.onward)
  SELECT user_id, event_type, event_id, ts FROM k"""


def requests_of_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts")
    )


@query(REPEATS_SQL)
def stream_dedup(spark, sf_dir):
    """Repeats less than an hour after a user's last kept request are dropped.  The quarters of
    the time arrive as second, first, fourth and third, so half of all requests come late and
    are settled after the stream."""
    work = scratch_dir(spark, "stream-dedup")
    rows = requests_of_events(spark, sf_dir)
    key, order = ["user_id", "event_type"], ["event_id"]

    def run(folder):
        arrived = spark.readStream.schema(rows.schema).parquet(folder)
        drop_duplicate_requests(
            arrived, f"{work}/out", f"{work}/checkpoint", key, "ts", order, "1 hour"
        ).awaitTermination()

    step = step_of_time(rows, F.col("ts"), 4)
    in_parts(spark, rows, 4, step + 1 - 2 * (step % 2), run)
    return kept_requests(spark, f"{work}/out", key, "ts", order, "1 hour")


@query(REPEATS_SQL)
def batch_dedup(spark, sf_dir):
    """The same as a batch over all requests."""
    return without_repeats(
        requests_of_events(spark, sf_dir), ["user_id", "event_type"], "ts", ["event_id"],
        micros("1 hour"),
    )


@query(ORACLE["session_timeline"])
def stream_timeline(spark, sf_dir):
    """What every session shows after each of its events, over four micro-batches.  Two of three
    events arrive six or twelve hours after their time; a closing row then moves the watermark
    past the last event."""
    work = scratch_dir(spark, "stream-timeline")
    events = session_events(spark, sf_dir)
    step = step_of_time(events, F.col("ts"), 4, F.col("event_id") % 3 * 6 * 3600)
    ends = events.agg(F.max("ts").alias("ts"))
    closing = ends.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"],
        (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"),
        F.lit(4).alias("step"),
    )

    def run(folder):
        arrived = spark.readStream.schema(events.schema).parquet(folder)
        session_state_stream(
            arrived, f"{work}/out", f"{work}/checkpoint", late="1 day"
        ).awaitTermination()

    stepped = events.withColumn("step", step).unionByName(closing)
    folder = in_parts(spark, stepped, 5, F.col("step"), run)
    landed = spark.read.parquet(f"{work}/out")
    arrived = spark.read.schema(events.schema).parquet(folder)
    return settled_timeline(landed, arrived).where(F.col("event_id").isNotNull())


@query(SESSION_STATE_SQL)
def stream_fold(spark, sf_dir):
    """State per session after all events."""
    work = scratch_dir(spark, "stream-fold")
    events = as_session_events(stream_table(spark, sf_dir, "events"))
    states = session_fold(events)
    write_batches(states, f"{work}/out", f"{work}/checkpoint", "update").awaitTermination()
    return read_session_states(spark, f"{work}/out")


@query(SESSION_STATE_SQL)
def session_states(spark, sf_dir):
    """The same fold as a batch."""
    return session_fold(as_session_events(table(spark, sf_dir, "events")))


@query(f"""
  SELECT doc_id, status, error, CASE WHEN status = 200 THEN final END AS final_category,
         CASE WHEN status = 200 THEN 'labelled' ELSE 'rejected' END AS outcome
  FROM ({STUB_RESULT_SQL})""")
def stream_label(spark, sf_dir):
    """Requests labelled as they arrive, in three micro-batches; labelled and rejected rows in
    two sinks."""
    work = scratch_dir(spark, "stream-label")
    documents = table(spark, sf_dir, "documents")

    def run(folder):
        arrived = spark.readStream.schema(documents.schema).parquet(folder)
        label_stream(
            as_requests(arrived), packs(spark, sf_dir), core_text(spark, sf_dir), stub_clients(),
            work, f"{work}/checkpoint",
        ).awaitTermination()

    in_parts(spark, documents, 3, F.col("doc_id") % 3, run)
    return spark.read.parquet(f"{work}/out").select(
        F.col("request_id").cast("long").alias("doc_id"), "status", "error", "final_category",
        "outcome",
    )
