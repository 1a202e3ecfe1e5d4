import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.constants import CATEGORIES, LOG_TEXT_CHARS
from twinlabel.functions.prompts import TEMPLATES, render_prompt
from twinlabel.operators.folds import evidence_profile, reroute_matrix
from twinlabel.operators.lookups import (
    attach_category_pack,
    attach_core_pack,
    attach_labels,
    attach_provider,
    lookup_join,
    unknown_provider_rows,
)
from twinlabel.plans import labelling
from twinlabel.plans.comparison import result_sections
from twinlabel.plans.labelling import build_model_requests, label_and_log, label_two_stage
from twinlabel.sources import reply_log
from twinlabel.sources.payloads import PayloadStore
from twinlabel.sources.readers import (
    provider_table,
    read_core_pack,
    read_label_requests,
    read_model_replies,
    read_pages,
    read_reference_packs,
)
from twinlabel.sources.writers import append_result_log

# The stand-in clients travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUEST = "request_id string, image_id string, provider string, image string, mime string, ts timestamp"


def requests(spark, rows):
    return spark.createDataFrame(
        [(i, f"img-{i}", p, image, "image/jpeg", None) for i, p, image in rows], REQUEST
    )


@pytest.fixture
def packs(spark):
    return spark.createDataFrame(
        [(c, f"about {c}") for c in CATEGORIES if c != "unknown"], "category string, text string"
    )


@pytest.fixture
def core(spark):
    return spark.createDataFrame([("look first",)], "text string")


def identification(**change):
    reply = {"category": "plumbing", "item_name": "valve", "most_likely_identification": "valve",
             "purchase_description": "a valve", "common_names": ["a", "b"], "visible_features": [],
             "specifications": [{"label": "d", "value": "8", "evidence_level": "observed"}],
             "uncertain_fields": []}
    return json.dumps({k: v for k, v in {**reply, **change}.items() if v is not ...})


def factory(calls):
    """Counts its calls in files, since clients run in other processes."""
    import pathlib
    import uuid

    def make():
        def answer(request):
            stage = request["schema_name"]
            pathlib.Path(calls, f"{stage}-{request['image']}-{uuid.uuid4().hex}").touch()
            image = request["image"]
            if stage == "category_routing":
                return {"EMPT": " ", "BADJ": "{", "NOCA": '{"category":"x","reason":""}',
                        "UNKN": '{"category":"unknown","reason":"?"}'}.get(
                            image, '{"category":"fasteners","reason":"has a thread"}')
            assert "about fasteners" in request["prompt"] and "look first" in request["prompt"]
            assert request["max_output_tokens"] == 2400 and "has a thread" in request["prompt"]
            if image == "FAIL" and not pathlib.Path(calls, "healed").exists():
                raise ConnectionError("down")
            if image == "HALF":
                return identification(item_name=...)
            return identification()

        return answer

    return {"gemini": make, "openai": make}


ROWS = [("1", "gemini", "GOOD"), ("2", "openai", "GOOD"), ("3", "gemini", "GOOD"), ("4", "grok", "GOOD"),
        ("5", "gemini", "not base64!"), ("6", "gemini", ""), ("7", "gemini", None), ("8", "gemini", "EMPT"),
        ("9", "gemini", "BADJ"), ("a", "gemini", "NOCA"), ("b", "gemini", "UNKN"), ("c", "gemini", "FAIL"),
        ("d", "gemini", "HALF"), ("e", None, "GOOD"), ("f", "grok", "bad!")]


def test_two_stages(spark, packs, core, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    work = str(tmp_path / "work")
    clients = factory(str(calls))
    got = {r.request_id: r
           for r in label_two_stage(requests(spark, ROWS), packs, core, clients, work).collect()}
    assert {i: (r.status, r.error) for i, r in got.items()} == {
        "1": (200, None), "2": (200, None), "3": (200, None),
        "4": (503, "provider_not_configured"),
        "5": (400, "bad_payload"), "6": (400, "bad_payload"), "7": (400, "bad_payload"),
        "8": (502, "routing: empty_reply"), "9": (502, "routing: bad_json"),
        "a": (502, "routing: incomplete_reply"), "b": (502, "reference text missing"),
        "c": (502, "identification: call_failed: ConnectionError: down"),
        "d": (502, "identification: incomplete_reply"),
        "e": (503, "provider_not_configured"), "f": (400, "bad_payload"),
    }
    one = got["1"].response
    assert (one.provider, one.routing.category, one.result.category) == ("gemini", "fasteners", "plumbing")
    assert one.result.common_names == ["a", "b"] and one.result.specifications[0].value == "8"
    assert json.loads(got["1"].payload)["routedCategory"] == "fasteners"
    assert got["1"].payload == got["3"].payload
    # Requests 1 and 3 send the same thing to the same model: one call each stage.
    made = sorted(p.name.rsplit("-", 1)[0] for p in calls.iterdir())
    assert made.count("category_routing-GOOD") == 2 and made.count("item_identification-GOOD") == 2

    # A rerun repeats only what failed.
    before = len(made)
    (calls / "healed").touch()
    again = {r.request_id: r.status
             for r in label_two_stage(requests(spark, ROWS), packs, core, clients, work).collect()}
    assert again == {**{i: r.status for i, r in got.items()}, "c": 200}
    assert len(list(calls.iterdir())) == before + 2  # one call and the marker file

    done = label_two_stage(requests(spark, ROWS[:3]), packs, core, clients, work)
    matrix = reroute_matrix(done, "provider").orderBy("provider").collect()
    assert [(r.provider, r.routed_category, r.plumbing, r.fasteners) for r in matrix] == [
        ("gemini", "fasteners", 2, None), ("openai", "fasteners", 1, None)]
    profile = evidence_profile(done.select("provider", "response.result.specifications"), "provider")
    assert {(r.provider, r.evidence_level, r.items) for r in profile.collect()} == {
        ("gemini", "observed", 2), ("openai", "observed", 1)}
    card = result_sections(done).first()
    assert (card.routed_label, card.final_label) == ("緊固／固定件", "水管／管件")
    assert card.names_line == "a／b" and card.uncertain_fields is None and len(card.specifications) == 1

    log = str(tmp_path / "log")
    logged = label_and_log(requests(spark, ROWS[:4]).withColumn("body_ok", F.col("request_id") != "2"),
                           packs, core, clients, work, log)
    assert {r.request_id: r.error for r in logged.collect()} == {
        "1": None, "2": "unreadable_body", "3": None, "4": "provider_not_configured"}
    assert spark.read.parquet(log).count() == 2
    log = str(tmp_path / "log2")
    append_result_log(done, None)
    append_result_log(done, log)
    append_result_log(done, log)
    assert spark.read.parquet(log).count() == 6


def test_a_filter_on_results_parses_no_reply_again(spark, packs, core, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    done = label_two_stage(
        requests(spark, ROWS), packs, core, factory(str(calls)), str(tmp_path / "work")
    ).where("status = 200")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("parseJson(") <= 3
    assert sorted(r.request_id for r in done.collect()) == ["1", "2", "3"]


def test_log_text_is_cut(spark, tmp_path):
    big = spark.range(1).select(F.repeat(F.lit("x"), LOG_TEXT_CHARS + 1).alias("payload"))
    append_result_log(big, str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert len(row.result_text) == LOG_TEXT_CHARS and len(row.full_text) == LOG_TEXT_CHARS + 1


def test_lookups(spark, packs, core):
    df = spark.createDataFrame([(1, "gemini", "plumbing", "observed"), (2, "grok", "unknown", "guess"),
                                (3, "other", None, None)],
                               "n int, provider string, category string, level string")
    got = (df.transform(attach_provider).transform(attach_category_pack, packs)
           .transform(attach_core_pack, core).transform(attach_labels, category="category", level="evidence")
           .orderBy("n").collect())
    assert [(r.n, r.model, r.provider_label, r.pack, r.core, r.category_label, r.level_label)
            for r in got] == [
        (1, "gemini-3.7-flash", "Gemini", "about plumbing", "look first", "水管／管件", "可見"),
        (2, "grok-4.6", "Grok", None, "look first", "其他／不明", "guess")]
    assert [r.n for r in unknown_provider_rows(df).collect()] == [3]
    assert provider_table(spark).count() == 3


def test_lookup_beyond_the_size_bound_is_not_broadcast(spark, packs):
    df = spark.createDataFrame([("plumbing",)] * 3, "category string")
    small = lookup_join(df, packs, "category")
    large = lookup_join(df, packs, "category", max_bytes=10)
    hinted = "ResolvedHint|strategy=broadcast"
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small) and "broadcast" not in plan(large), hinted
    assert small.collect() == large.collect()


def test_core_text_must_be_one_row(spark, packs):
    with pytest.raises(Exception):
        attach_core_pack(packs, packs.select("text")).collect()


def test_render_prompt(evaluate):
    got = evaluate([("{{b}}", "x"), (None, "y")], "a string, b string",
                   render_prompt("1{{a}}2{{b}}3{{a}}", a=F.col("a"), b=F.col("b")))
    assert got == ["1{{b}}2x3{{b}}", "12y3"]
    with pytest.raises(ValueError):
        render_prompt("{{zzz}}")


def test_request_bodies(spark):
    rows = requests(spark, [("1", "gemini", "QUJD"), ("2", "openai", "QUJD"), ("3", "gemini", "QUJD")])
    built = {r.request_id: r for r in
             build_model_requests(rows, 2, F.lit("p")).collect()}
    g, r = json.loads(built["1"].body), json.loads(built["2"].body)
    assert g["contents"][0]["parts"] == [{"inline_data": {"data": "QUJD", "mime_type": "image/jpeg"}},
                                         {"text": "p"}]
    assert g["generationConfig"]["maxOutputTokens"] == 2400
    assert len(g["generationConfig"]["responseJsonSchema"]["required"]) == 16
    content = r["input"][0]["content"]
    assert content[0]["image_url"] == "data:image/jpeg;base64,QUJD" and content[1]["text"] == "p"
    assert r["model"] == "gpt-5.6-sol" and r["text"]["format"]["strict"] is True
    assert built["1"].call_key == built["3"].call_key != built["2"].call_key
    small = build_model_requests(rows, 2, F.lit("p"), budget=1800).where("request_id = '2'").first()
    assert json.loads(small.body)["max_output_tokens"] == 1800
    other = build_model_requests(rows, 1, T.render_prompt(TEMPLATES[1])).where("request_id = '1'").first()
    assert other.call_key != built["1"].call_key


def test_sources(spark, tmp_path):
    for name in ("fasteners", "plumbing", "electrical", "building-hardware", "general-repair"):
        (tmp_path / "ref" / name).mkdir(parents=True)
        (tmp_path / "ref" / name / "notes.md").write_text(f"# {name}\nline 二\n", encoding="utf-8")
    (tmp_path / "ref/core").mkdir()
    (tmp_path / "ref/core/principles.md").write_text("core\ntext")
    packs = {r.category: r.text for r in read_reference_packs(spark, str(tmp_path / "ref")).collect()}
    assert set(packs) == set(CATEGORIES) and packs["unknown"] == packs["general-repair"]
    assert packs["plumbing"] == "# plumbing\nline 二\n"
    assert read_core_pack(spark, str(tmp_path / "ref")).first().text == "core\ntext"

    (tmp_path / "r.json").write_text('{"request_id":"1","image":"QQ=="}\n{"request_id":"2","image":5}\n'
                                     '{"request_id":"3"}\n{"request_id":"4","image":null}\n{"request')
    got = read_label_requests(spark, str(tmp_path / "r.json"), "json").orderBy("request_id").collect()
    assert [(r.image, r.body_ok) for r in got] == [
        ("", False), ("QQ==", True), ("", True), ("", True), ("", True)]

    replies = spark.createDataFrame([("1", "1", "gemini", 200, "{}")],
                                    "request_id string, stage string, provider string, http_status int, body string")
    replies.write.json(str(tmp_path / "replies"))
    assert read_model_replies(spark, str(tmp_path / "replies"), "json").collect() == replies.collect()
    spark.createDataFrame([(1, "http://x", "<p>")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages"))
    assert read_pages(spark, str(tmp_path / "pages")).columns == [
        "page_id", "url", "html", "content_type", "image_hint"]


def test_replies_of_finished_tasks_survive_a_failed_job(spark, packs, core, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / "healed").touch()
    work = str(tmp_path / "work")

    def broken():
        def answer(request):
            import os
            import time

            if request["image"] == "A019":
                time.sleep(4)
                os._exit(1)
            return '{"category":"fasteners","reason":"has a thread"}'

        return answer

    rows = requests(spark, [(str(i), "gemini", f"A{i:03d}") for i in range(40)])
    with pytest.raises(Exception):
        label_two_stage(rows, packs, core, {"gemini": broken}, work, max_clients=4)
    kept = spark.read.parquet(f"{work}/stage=1").count()
    assert 0 < kept < 40
    done = label_two_stage(rows, packs, core, factory(str(calls)), work)
    assert done.where("status = 200").count() == 40
    made = [p.name for p in calls.iterdir() if p.name.startswith("category_routing")]
    assert len(made) == 40 - kept


def test_an_id_that_repeats_keeps_each_image_to_its_own_call(spark, packs, core, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [("same", "gemini", "GOOD"), ("same", "gemini", "EMPT"), ("same", "gemini", "GOOD")]
    got = labelling.label_two_stage(
        requests(spark, rows), packs, core, factory(str(calls)), str(tmp_path / "work")
    ).collect()
    assert sorted(r.status == 200 for r in got) == [False, True, True]
    sent = sorted(c.name.rsplit("-", 1)[0] for c in calls.iterdir())
    assert sent == ["category_routing-EMPT", "category_routing-GOOD", "item_identification-GOOD"]


def test_speculation_is_refused(spark, packs, core, tmp_path, monkeypatch):
    monkeypatch.setattr(labelling, "speculates", lambda _: True)
    with pytest.raises(ValueError, match="speculation"):
        label_two_stage(requests(spark, ROWS[5:6]), packs, core, {}, str(tmp_path / "w"))
    assert not (tmp_path / "w").exists()


def test_payloads_stay_in_their_buckets(spark, tmp_path):
    rows = requests(spark, [(str(i % 7), "gemini", f"A{i:03d}") for i in range(50)])
    store = PayloadStore(rows.select("request_id", "image"), str(tmp_path / "store"), 3)
    calls = store.rows().where("place % 2 = 0").select("place", "request_id")
    joined = store.beside(calls, "image")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line and "image" in line]
    assert len(scans) == 1 and "Bucketed: true" in scans[0]
    # The only exchange is that of the narrow side.
    before = plan[: plan.index(scans[0])]
    assert plan.count("Exchange") <= 1 and "Sort" not in before
    assert joined.rdd.getNumPartitions() == 3
    want = {(r.place, r.image) for r in store.rows().collect() if r.place % 2 == 0}
    assert {(r.place, r.image) for r in joined.collect()} == want
    store.drop()
    assert not (tmp_path / "store").exists()


def test_a_failed_task_repeats_one_batch_at_most(spark, packs, core, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / "healed").touch()
    work = str(tmp_path / "work")
    asked = tmp_path / "asked"
    asked.mkdir()

    def fragile():
        def answer(request):
            import os
            import pathlib

            seen = len(os.listdir(asked))
            pathlib.Path(asked, f"{seen:04d}-{request['image']}").touch()
            if seen == 25:
                os._exit(1)
            return '{"category":"fasteners","reason":"has a thread"}'

        return answer

    rows = requests(spark, [(str(i), "gemini", f"A{i:03d}") for i in range(40)])
    with pytest.raises(Exception):
        label_two_stage(rows, packs, core, {"gemini": fragile}, work, max_clients=1, batch_calls=4)
    # 25 calls were answered: six batches of four are kept.
    assert spark.read.parquet(f"{work}/stage=1").count() == 24
    done = label_two_stage(rows, packs, core, factory(str(calls)), work, max_clients=1, batch_calls=4)
    assert done.where("status = 200").count() == 40
    assert len([p for p in calls.iterdir() if p.name.startswith("category_routing")]) == 16


def test_an_attempt_goes_on_where_the_last_one_stopped(spark, tmp_path, monkeypatch):
    """The files of the same job and task are not asked for again."""
    fixed = type("Id", (), {"hex": "job"})
    monkeypatch.setattr(reply_log.uuid, "uuid4", lambda: fixed)
    rows = [(f"k{i}", "p", "m", "q", "i", "j") for i in range(10)]
    calls = spark.createDataFrame(rows, "call_key string, provider string, model string, "
                                        "prompt string, image string, mime string").coalesce(1)
    asked = tmp_path / "asked"
    asked.mkdir()

    def client():
        class Many:
            def many(self, requests):
                import pathlib

                for r in requests:
                    pathlib.Path(asked, r["call_key"]).touch()
                return [ValueError("odd") if r["call_key"] == "k3" else r["call_key"] for r in requests]

        return Many()

    path = str(tmp_path / "replies")
    reply_log.append_replies(calls.where("call_key < 'k6'"), {"p": client}, {}, path, 2)
    for name in list(asked.iterdir()):
        name.unlink()
    reply_log.append_replies(calls, {"p": client}, {}, path, 3)
    assert sorted(p.name for p in asked.iterdir()) == ["k6", "k7", "k8", "k9"]
    got = {r.call_key: (r.reply_text, r.error) for r in spark.read.parquet(path).collect()}
    assert len(got) == 10 and got["k3"] == (None, "ValueError: odd") and got["k9"] == ("k9", None)


def test_an_attempt_looks_at_its_own_files_only(tmp_path):
    names = [f"job-000001-{n:06d}" for n in range(3)] + [f"job-000002-{n:06d}" for n in range(40)]
    for name in names:
        (tmp_path / f"{name}.parquet").touch()
    asked = []

    class Store:
        def get_file_info(self, paths):
            asked.extend(paths)
            return reply_log.fs.LocalFileSystem().get_file_info(paths)

    got = reply_log.committed(Store(), str(tmp_path), "job-000001-")
    assert got == [str(tmp_path / f"{name}.parquet") for name in names[:3]]
    assert len(asked) == 4 and reply_log.committed(Store(), str(tmp_path / "none"), "job-000001-") == []


def test_replies_are_handed_on_without_the_log(spark, tmp_path, monkeypatch):
    """What a job asked, an earlier attempt's part included, is a table with a file per task."""
    fixed = type("Id", (), {"hex": "job"})
    monkeypatch.setattr(reply_log.uuid, "uuid4", lambda: fixed)
    rows = [(f"k{i}", "p", "m", "q", "i", "j") for i in range(10)]
    calls = spark.createDataFrame(rows, "call_key string, provider string, model string, "
                                        "prompt string, image string, mime string").coalesce(1)

    def client():
        def answer(request):
            if request["call_key"] == "k3":
                raise ValueError("odd")
            return request["call_key"]

        return answer

    path = str(tmp_path / "replies")
    reply_log.append_replies(calls.where("call_key < 'k6'"), {"p": client}, {}, path, 2)
    table = reply_log.append_replies(calls, {"p": client}, {}, path, 2, str(tmp_path / "answered"))
    got = sorted(map(tuple, table.collect()), key=str)
    assert got == sorted(map(tuple, spark.read.parquet(path).select(*table.columns).collect()), key=str)
    assert len(got) == 10 and ("k3", "p", None, "ValueError: odd") in got
    assert len(table.inputFiles()) == 1 and len(spark.read.parquet(path).inputFiles()) == 5
    none = reply_log.append_replies(calls.where("false"), {"p": client}, {}, str(tmp_path / "no"), 2,
                                    str(tmp_path / "none"))
    assert none.count() == 0


def test_what_is_asked_for_is_part_of_the_key(spark):
    rows = requests(spark, [("1", "gemini", "QUJD")])
    keys = [
        build_model_requests(r, 2, F.lit("p"), budget).first().call_key
        for r, budget in ((rows, None), (rows.withColumn("mime", F.lit("image/png")), None), (rows, 1800))
    ]
    assert len(set(keys)) == 3
    assert keys[0] == build_model_requests(rows, 2, F.lit("p"), 2400).first().call_key


@pytest.mark.parametrize("many", [
    lambda self, requests: ["only one"],
    lambda self, requests: 1 / 0,
])
def test_a_client_that_fails_as_a_whole(many):
    client = type("Client", (), {"many": many})()
    got = reply_log.ask(client, [{"a": 1}, {"a": 2}])
    assert len(got) == 2 and all(text is None and error for text, error in got)


def test_another_table_of_providers(spark, packs, core, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    own = [("mine", "model-7", "Mine", "")]
    rows = requests(spark, [("1", "mine", "GOOD"), ("2", "gemini", "GOOD")])
    make = factory(str(calls))["gemini"]
    got = {r.request_id: (r.status, r.model) for r in label_two_stage(
        rows, packs, core, {"mine": make, "gemini": make}, str(tmp_path / "w"), providers=own).collect()}
    assert got == {"1": (200, "model-7"), "2": (503, None)}
    known = attach_provider(rows, own).first()
    assert (known.model, known.provider_label, known.provider_ordinal) == ("model-7", "Mine", 0)
    assert [r.request_id for r in unknown_provider_rows(rows, own).collect()] == ["2"]
