"""Streams with state: repeats, newest values, state after every event."""

import datetime as dt
import random

import pytest

from twinlabel.operators import folds, repeats
from twinlabel.operators.timeline import session_timeline
from twinlabel.streaming import streams
from twinlabel.streaming.stateful import micros

START = dt.datetime(2024, 1, 1)
REQUEST = "request_key string, ts timestamp, request_id long"


def feed(spark, rows, schema, folder, run):
    """Every list of rows arrives and is worked on before the next one."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(folder)
        run(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder))


def greedy(rows, bound):
    kept, last = set(), {}
    for key, ts, number in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[2])):
        if ts is None or key not in last or ts - last[key] >= bound:
            kept.add((key, ts, number))
            if ts is not None:
                last[key] = ts
    return kept


def two_months(seed, size=400):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["warm", "cold", None]
    rows = []
    for n in range(size):
        day, second = draw.randrange(60), draw.randrange(3 * 3600)
        rows.append((draw.choice(keys), START + dt.timedelta(days=day, seconds=second), n))
    rows += [("hot", rows[3][1], 10_000 + n) for n in range(30)] + [("none", None, n) for n in (1, 2)]
    # A chain in which each request lies within the bound of the one before it.
    rows += [("chain", START + dt.timedelta(minutes=4 * n), 20_000 + n) for n in range(50)]
    return rows


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_repeats_of_a_batch(spark, chunks):
    rows = two_months(chunks)
    got = repeats.without_repeats(
        spark.createDataFrame(rows, REQUEST), ["request_key"], "ts", ["request_id"],
        micros("10 minutes"), chunks,
    ).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.request_key, r.ts, r.request_id) for r in got} == greedy(rows, dt.timedelta(minutes=10))
    none = spark.createDataFrame([], REQUEST)
    assert repeats.without_repeats(none, ["request_key"], "ts", ["request_id"], 1).count() == 0


def test_repeats_of_a_stream_in_any_order(spark, tmp_path):
    rows = two_months(5)
    random.Random(1).shuffle(rows)
    out = str(tmp_path / "out")
    feed(spark, [rows[:180], rows[180:190], rows[190:]], REQUEST, str(tmp_path / "in"), lambda s: (
        streams.drop_duplicate_requests(s, out, str(tmp_path / "cp")).awaitTermination()))
    landed = spark.read.parquet(out)
    assert landed.count() == len(rows)
    assert {r.outcome for r in landed.select("outcome").distinct().collect()} == {
        "kept", "dropped", "late"}
    got = {(r.request_key, r.ts, r.request_id) for r in streams.kept_requests(spark, out).collect()}
    assert got == greedy(rows, dt.timedelta(minutes=10))


def test_state_of_a_key_goes_with_its_bound(spark, tmp_path):
    days = [[(f"key-{d}-{n}", START + dt.timedelta(days=d), n) for n in range(20)] for d in range(4)]
    left = []

    def run(stream):
        query = streams.drop_duplicate_requests(
            stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour")
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    feed(spark, days, REQUEST, str(tmp_path / "in"), run)
    assert max(left) <= 20
    assert spark.read.parquet(str(tmp_path / "out")).where("outcome = 'kept'").count() == 80


def test_reader_of_newest_values_touches_few_folders(spark, tmp_path):
    schema = "image_id string, provider string, ts timestamp, request_id long"
    draw = random.Random(4)
    rows = [(draw.choice("abc"), draw.choice(["x", None]), START + dt.timedelta(seconds=draw.randrange(99)), n)
            for n in range(100)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(20):
        spark.createDataFrame(rows[5 * n : 5 * n + 5], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.latest_result_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert streams.live_spans(spark, out) == [(16, 19), (0, 15)]
    want = folds.latest_result(spark.createDataFrame(rows, schema), ("image_id", "provider"), ("ts", "request_id"))
    got = streams.read_latest(spark, out)
    assert set(got.collect()) == set(want.select(got.columns).collect())


EVENT = ("session_id string, image_seq int, provider string, kind string, ts timestamp, "
         "event_id long, result string, error string")


def session_rows(seed, size=160):
    draw = random.Random(seed)
    rows = []
    for n in range(size):
        minute = n * 5
        rows.append((
            draw.choice(["s1", "s1", "s2"]), max(0, minute // 200 - draw.randrange(2)),
            draw.choice(["gemini", "openai", None]), draw.choice(["image", "start", "ok", "error"]),
            START + dt.timedelta(minutes=minute), n, f"r{n}", draw.choice([f"e{n}", None]),
        ))
    return rows


@pytest.mark.parametrize("late", ["2 hours", "1 minute"])
def test_state_after_each_event(spark, tmp_path, late):
    """Within the bound nothing is late; below it late sessions are settled in a batch."""
    rows = session_rows(3)
    ends = [("end", 0, None, "image", START + dt.timedelta(days=9), -1, None, None)]
    order = sorted(rows, key=lambda r: r[4] + dt.timedelta(minutes=r[5] % 4 * 25))
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    feed(spark, [order[:50], order[50:100], order[100:], ends], EVENT, folder, lambda s: (
        streams.session_state_stream(s, out, str(tmp_path / "cp"), late=late).awaitTermination()))
    landed = spark.read.parquet(out).where("session_id <> 'end'")
    assert landed.count() == len(rows)
    assert (landed.where("outcome = 'late'").count() > 0) == (late == "1 minute")
    events = spark.createDataFrame(rows, EVENT)
    want = session_timeline(events)
    got = streams.settled_timeline(landed, events).select(want.columns)
    assert set(got.collect()) == set(want.collect()) and got.count() == len(rows)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    days = [
        [(f"s{d}-{n}", 1, "gemini", "ok", START + dt.timedelta(days=d), 10 * d + n, "r", None) for n in range(9)]
        for d in range(5)
    ]
    left = []

    def run(stream):
        query = streams.session_state_stream(
            stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour", idle="2 hours")
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    feed(spark, days, EVENT, str(tmp_path / "in"), run)
    # Those that wait, and those shown last.
    assert max(left) <= 2 * 9 * 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 36


def test_keys_share_the_rows_of_the_state(spark, tmp_path):
    rows = [(f"key-{n}", START + dt.timedelta(seconds=n % 60), n) for n in range(5000)]
    left = []

    def run(stream):
        query = streams.drop_duplicate_requests(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    feed(spark, [rows], REQUEST, str(tmp_path / "in"), run)
    assert max(left) <= 2 * 1024
    assert spark.read.parquet(str(tmp_path / "out")).where("outcome = 'kept'").count() == 5000
