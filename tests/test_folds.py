import random

import pytest
from pyspark.sql import functions as F

from twinlabel.operators import folds
from twinlabel.operators.timeline import session_timeline
from twinlabel.plans.comparison import compare_providers
from twinlabel.plans.pages import resolve_page_images
from twinlabel.session import work_dir
from twinlabel.streaming.streams import (
    label_stream,
    read_session_states,
    session_fold,
    write_batches,
)

PROVIDERS = ("gemini", "openai", "grok")
EVENT = ("session_id long, image_seq int, provider string, kind string, ts timestamp, event_id long, "
         "result double, error string")


def random_events(n=400, seed=3):
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # Session 0 is hot and some events share a timestamp.
        session = 0 if rng.random() < 0.5 else rng.randrange(1, 8)
        kind = rng.choice(["image", "start", "start", "ok", "error"])
        image = max(0, i // 60 - rng.choice([0, 0, 0, 1]))
        rows.append((session, image, None if kind == "image" else rng.choice(PROVIDERS), kind,
                     dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 3), i, float(i), f"e{i}"))
    return rows


def plain_timeline(rows):
    """Event by event, as one viewer would see it."""
    out, state = {}, {}
    for s, image, provider, kind, ts, event, result, error in sorted(rows, key=lambda r: (r[4], r[5])):
        now = state.setdefault(s, {"image": None, "result": {}, "error": {}})
        if now["image"] is None or image > now["image"]:
            now.update(image=image, result={}, error={})
        if image == now["image"] and provider:
            if kind == "ok":
                now["result"][provider] = result
            elif kind in ("start", "error"):
                now["error"][provider] = error if kind == "error" else None
        out[event] = (s, now["image"], *[x for p in PROVIDERS
                                         for x in (now["result"].get(p), now["error"].get(p))])
    return out


COLUMNS = [f"{p}_{k}" for p in PROVIDERS for k in ("result", "error")]


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_timeline_agrees_with_plain_fold(spark, chunks):
    rows = random_events()
    got = session_timeline(spark.createDataFrame(rows, EVENT), chunks=chunks).collect()
    assert {r.event_id: (r.session_id, r.image, *[r[c] for c in COLUMNS]) for r in got} == plain_timeline(rows)


def final_states(rows):
    last = {}
    timeline = plain_timeline(rows)
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        last[r[0]] = timeline[r[5]][1:]
    return last


def test_session_fold_batch_and_reset(spark):
    rows = random_events(seed=5)
    df = spark.createDataFrame(rows, EVENT)
    want = final_states(rows)
    got = {r.session_id: (r.image, *[r[c] for c in COLUMNS]) for r in session_fold(df).collect()}
    assert got == want
    reset = folds.reset_on_new_image(df).collect()
    for r in reset:
        image, *state = want[r.session_id]
        at = PROVIDERS.index(r.provider) * 2
        assert (r.image_seq, r.result, r.error) == (image, *state[at:at + 2])


def test_older_result_stays_beside_newer_error(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, 0, m) for m in range(6)]
    rows = [(1, 0, "grok", "ok", t[0], 1, 7.0, None), (1, 0, "grok", "start", t[1], 2, None, None),
            (1, 0, "grok", "error", t[2], 3, None, "boom"), (1, 0, "openai", "error", t[3], 4, None, "x"),
            (1, 0, "openai", "start", t[4], 5, None, None)]
    df = spark.createDataFrame(rows, EVENT)
    got = {r.provider: (r.result, r.error)
           for r in folds.provider_state(df, ("session_id", "provider")).collect()}
    assert got == {"grok": (7.0, "boom"), "openai": (None, None)}


def test_latest_and_compare(spark):
    rows = [("i", "grok", 1, "a", "old"), ("i", "grok", 2, "a", "tie"), ("i", "grok", 2, "b", "new"),
            ("i", "gemini", 1, "c", "g"), ("j", "zzz", 1, "d", "lost")]
    df = spark.createDataFrame(rows, "image_id string, provider string, ts int, request_id string, response string")
    assert {(r.image_id, r.provider): r.response for r in folds.latest_result(df).collect()} == {
        ("i", "grok"): "new", ("i", "gemini"): "g", ("j", "zzz"): "lost"}
    table = compare_providers(df)
    assert table.columns == ["image_id", *PROVIDERS]
    assert [tuple(r) for r in table.collect()] == [("i", "g", None, "new")]
    assert {(r.image_id, r.completed, r.expected) for r in folds.completed_count(df).collect()} == {
        ("i", 2, 3), ("j", 0, 3)}


def test_attempts(spark):
    log = [("a", 1, False, "e1"), ("a", 2, True, None), ("a", 3, True, None), ("b", 1, False, "e1"),
           ("b", 2, False, "e2"), ("b", 3, False, "e3"), ("b", 4, True, None), ("c", 1, True, None),
           ("d", 1, False, None)]
    df = spark.createDataFrame(log, "id string, attempt int, ok boolean, error string")
    got = {r.id: tuple(r)[1:] for r in folds.first_success_attempt(df).collect()}
    assert got == {"a": (2, 2, None, 2), "b": (None, 3, "e3", 6), "c": (1, 1, None, 0),
                   "d": (None, 1, "download failed", 0)}


def test_numbering_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    numbered = folds.number_attempts(df, ["k"], ["id"])
    assert numbered.count() == 9
    assert "WindowGroupLimit" in numbered._jdf.queryExecution().executedPlan().toString()


def test_summaries(spark):
    df = spark.createDataFrame([("g", True, "ok", "ok"), ("g", False, "ok", "failed"), ("h", None, "bad", None)],
                               "g string, category_match boolean, preflight_status string, api_status string")
    assert {tuple(r) for r in folds.accuracy_by_group(df, "g").collect()} == {("g", 2, 1, 0.5), ("h", 1, 0, 0.0)}
    assert tuple(folds.run_verdict(df).first()) == (3, 2, False)
    assert tuple(folds.run_verdict(df.limit(1)).first()) == (1, 0, True)
    assert {tuple(r) for r in folds.status_summary(df).collect()} == {
        ("ok", "ok", 1), ("ok", "failed", 1), ("bad", None, 1)}


def test_page_images(spark):
    og = '<meta property="og:image" content="/og&amp;amp;1">'
    rows = [
        ("hint", '<img src="/a.jpg"><img src="b.PNG?x"><img src="/a.jpg">', None, "B.png", None),
        ("miss", '<img src="/a.jpg">' + og, "text/html; charset=x", "zzz", None),
        ("og", og, None, None, None),
        ("first", '<a href="x.pdf"><img src="img\\/c.jpg"> https://z/q.gif', None, None, None),
        ("explicit", '<img src="/a.jpg">', "application/pdf", None, "http://e/f"),
        ("pdf", '<img src="/a.jpg">', "application/pdf", None, ""),
        ("none", '<a href="x.pdf">', None, None, None),
        ("bad", '<img src="/a.jpg"><a href="http://[x">', None, None, None),
        ("middle", '<img src="https://c/x.webp/large">', None, None, None),
    ]
    pages = spark.createDataFrame(
        [(i, "https://s.t/p/", h, c, n, u) for i, h, c, n, u in rows],
        "page_id string, url string, html string, content_type string, image_hint string, image_url string",
    )
    got = {r.page_id: (r.image_status, r.image) for r in resolve_page_images(pages).collect()}
    assert got == {
        "hint": ("ok", "https://s.t/p/b.PNG?x"),
        "miss": ("ok", "https://s.t/og&1"),
        "og": ("ok", "https://s.t/og&1"),
        "first": ("ok", "https://s.t/p/img/c.jpg"),
        "explicit": ("ok", "http://e/f"),
        "pdf": ("not_html", None),
        "none": ("unresolved", None),
        "bad": ("bad_link", None),
        "middle": ("ok", "https://c/x.webp/large"),
    }


# ---------------------------------------------------------------- streams
def as_stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
            .parquet(path))


def test_stream_folds_equal_batch(spark, tmp_path):
    rows = random_events(seed=9)
    df = spark.createDataFrame(rows, EVENT)
    stream = as_stream(spark, df, str(tmp_path / "in"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    write_batches(session_fold(stream), out, cp, "update").awaitTermination()
    assert len({r[0] for r in spark.read.parquet(out).select("batch").distinct().collect()}) == 3
    assert set(read_session_states(spark, out).collect()) == set(session_fold(df).collect())


def test_label_stream_two_sinks(spark, tmp_path):
    from test_labelling import REQUEST, ROWS, factory

    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(i, f"img-{i}", p, image, "image/jpeg", None) for i, p, image in ROWS]
    stream = as_stream(spark, spark.createDataFrame(rows, REQUEST), str(tmp_path / "in"), 2)
    packs = spark.createDataFrame([("fasteners", "about fasteners")], "category string, text string")
    core = spark.createDataFrame([("look first",)], "text string")
    work = str(tmp_path / "work")
    label_stream(stream, packs, core, factory(str(calls)), work, str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    assert {r.request_id for r in out.where("outcome = 'labelled'").collect()} == {"1", "2", "3"}
    assert out.where("outcome = 'rejected'").count() == len(ROWS) - 3


def test_work_dir_reads_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first.startswith(base) and first != second
