import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.operators.folds import failure_count
from twinlabel.operators.gates import (
    BASIC_POLICY,
    failed_rows,
    ground_truth_gate,
    policy_gate,
    request_status,
    require_gates,
)
from twinlabel.operators.joins import (
    case_join,
    hot_key_join,
    last_prepared,
    prepared_rows,
    unprepared_rows,
)
from twinlabel.operators.reports import (
    dataset_order,
    image_source,
    numbered,
    order_by_id,
    provider_order,
    unify_datasets,
)
from twinlabel.plans.evaluation import (
    evaluate_gated,
    evaluate_isolated,
    evaluation_run,
    report_header,
)
from twinlabel.sources.readers import (
    dataset_header,
    explode_cases,
    read_eval_dataset,
    read_large_dataset,
)
from twinlabel.sources.writers import write_eval_report

POLICY = {"generated_images_allowed": False, "ground_truth_required": True,
          "ground_truth_established_before_inference": True}


def case(i, **more):
    return {"id": i, "image_url": f"http://i/{i}", "source_page": f"http://p/{i}",
            "ground_truth": {"category": "plumbing", "item_name": "brass ball valve",
                             "taiwan_purchase_name": "球閥", "accepted_names_zh_tw": ["球閥"],
                             "specifications": {"size": "1/2", "material": "brass", "空": "無"}}, **more}


def dataset(spark, tmp_path, cases, policy=POLICY, name="d.json"):
    path = tmp_path / name
    path.write_text(json.dumps({"version": "v1", "policy": policy, "cases": cases},
                               ensure_ascii=False), encoding="utf-8")
    return read_eval_dataset(spark, str(path))


def reply(answer, status=200):
    text = answer if isinstance(answer, str) else json.dumps(answer)
    return status, json.dumps({"output": [{"content": [{"type": "output_text", "text": text}]}]})


def images(spark, rows):
    return spark.createDataFrame(
        [(i, s, e, 10, f"http://r/{i}") for i, s, e in rows],
        "id string, status string, error string, original_bytes long, resolved_url string",
    )


def replies(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in rows], "id string, http_status int, body string")


def test_dataset_shapes_and_open_keys(spark, tmp_path):
    a = case("ü-1", category_group="g", source_type="shop", image_hint="x")
    del a["image_url"]
    rows = explode_cases(dataset(spark, tmp_path, [case("2"), a])).orderBy("pos").collect()
    assert [(r.pos, r.id, r.dataset_version) for r in rows] == [(0, "2", "v1"), (1, "ü-1", "v1")]
    assert rows[1].image_url is None and rows[1].category_group == "g"
    assert rows[0].ground_truth.specifications == {"size": "1/2", "material": "brass", "空": "無"}


@pytest.mark.parametrize("change, broken", [
    ({}, []),
    ({"generated_images_allowed": True}, ["generated_images_allowed"]),
    ({"generated_images_allowed": None}, ["generated_images_allowed"]),
    ({"ground_truth_required": False}, ["ground_truth_required"]),
    ({"ground_truth_established_before_inference": None},
     ["ground_truth_established_before_inference"]),
])
def test_policy_gate(spark, tmp_path, change, broken):
    policy = {k: v for k, v in {**POLICY, **change}.items() if v is not None}
    data = dataset(spark, tmp_path, [case("1")], policy)
    header, cases = dataset_header(data), explode_cases(data)
    assert policy_gate(header).first().violations == broken
    basic = [b for b in broken if b in BASIC_POLICY]
    assert policy_gate(header, BASIC_POLICY).first().violations == basic
    if broken:
        with pytest.raises(ValueError, match=broken[0]):
            require_gates(header, cases)
    else:
        require_gates(header, cases)


def test_ground_truth_gate_names_the_first(spark, tmp_path):
    empty, null, absent = case("b", ground_truth={}), case("a", ground_truth=None), case("c")
    del absent["ground_truth"]
    data = dataset(spark, tmp_path, [case("0"), empty, null, absent])
    verdict = ground_truth_gate(explode_cases(data)).first()
    assert (verdict.missing_cases, verdict.first_id) == (3, "b")
    with pytest.raises(ValueError, match="b has no ground truth"):
        require_gates(dataset_header(data), explode_cases(data))


GOOD = {"answer": {"category": "Plumbing", "item_name": "ball valve x",
                   "specifications": {"size": None, "extra": 1, "material": ["brass"]}}}


def test_isolated_run(spark, tmp_path):
    ids = "ok skip none http body shape empty json list null absent five spec nospec".split()
    cases = [case(i) for i in ids]
    cases[-1]["ground_truth"]["specifications"] = {}
    cases = explode_cases(dataset(spark, tmp_path, cases))
    imgs = images(spark, [(i, "ok", None) for i in ids if i != "skip"] + [("skip", "failed", "too_small")])
    bad_spec = {"answer": {"category": "plumbing", "item_name": "valve", "specifications": "none"}}
    rows = replies(spark, [
        ("ok", reply("```json\n" + json.dumps(GOOD) + "\n```")),
        ("http", (503, '{"error":{"code":"c","message":"m"}}')),
        ("body", (200, "<html>")), ("shape", (200, '{"output":null}')), ("empty", (200, "{}")),
        ("json", reply('{"answer": {}} and more')), ("list", reply([1])),
        ("null", reply({"answer": None})), ("absent", reply({"diagnostic": {}})),
        ("five", reply({"answer": 5})), ("spec", reply(bad_spec)), ("nospec", reply(bad_spec)),
        ("skip", reply(GOOD)),
    ])
    report = dataset_order(evaluate_isolated(cases, imgs, rows))
    got = {r.id: r for r in report.collect()}
    assert list(got) == ids
    assert {i: (r.api_status, r.api_error) for i, r in got.items()} == {
        "ok": ("ok", None),
        "skip": ("skipped", None),
        "none": ("failed", "no_reply: none landed"),
        "http": ("failed", "HTTP 503: c m"),
        "body": ("failed", "bad_json: reply body"),
        "shape": ("failed", "bad_shape: reply body"),
        "empty": ("failed", "empty_reply: no text"),
        "json": ("failed", 'bad_json: {"answer": {}} and more'),
        "list": ("failed", "bad_reply: not an object"),
        "null": ("failed", "bad_reply: answer is not an object"),
        "absent": ("ok", None),
        "five": ("failed", "bad_reply: answer is not an object"),
        "spec": ("failed", "bad_reply: specifications is not an object"),
        "nospec": ("ok", None),
    }
    ok = got["ok"]
    assert ok.result.category_match and ok.result.item_name_match
    specs = {k: str(v.ai_answer) for k, v in ok.result.specifications.items()}
    assert specs == {"size": "null", "material": '["brass"]', "空": '"<not provided>"'}
    assert ok.image.url == "http://i/ok" and ok.image.validation.status == "ok"
    skip = got["skip"]
    assert skip.image.validation.status == "download_failed" and skip.image.validation.error == "too_small"
    assert skip.ai_response is None and skip.result is None
    # A reply that was fine but could not be compared is kept; one that never parsed is not there.
    kept = {i for i, r in got.items() if r.ai_response is not None}
    assert kept == {"ok", "list", "null", "absent", "five", "spec", "nospec"}
    assert not got["absent"].result.category_match
    assert report.agg(failure_count(F.col("api_status"))).first()[0] == 11
    assert failed_rows(report).count() == 11


def test_gated_run_holds_everything(spark, tmp_path):
    cases = explode_cases(dataset(spark, tmp_path, [case("b"), case("a"), case("c")]))
    imgs = images(spark, [("a", "ok", None), ("b", "failed", "empty_body")])
    report = order_by_id(evaluate_gated(cases, imgs, replies(spark, [("a", reply(GOOD))])))
    rows = report.collect()
    assert [(r.id, r.api_status, r.image.validation.status) for r in rows] == [
        ("a", "skipped_global_preflight", "ok"), ("b", "skipped_global_preflight", "preflight_failed"),
        ("c", "skipped_global_preflight", "preflight_failed")]
    assert rows[0].image.resolved_url == "http://r/a" and rows[1].image.resolved_url is None
    assert rows[0].ai_response is None and rows[2].image.validation.error == "download failed"


def test_gated_run_open_and_report(spark, tmp_path):
    data = dataset(spark, tmp_path, [case("b", category_group="g"), case("a"), case("c"), case("d")])
    imgs = images(spark, [(i, "ok", None) for i in "abcd"])
    answer = {"answer": {"category": "plumbing", "item_name_zh_tw": "球閥", "specifications": None}}
    rows = replies(spark, [("a", reply(answer)), ("b", reply({"answer": None})), ("c", reply({"answer": [1]})),
                           ("d", reply({"answer": []}))])
    report = evaluate_gated(explode_cases(data), imgs, rows)
    got = {r.id: r for r in report.collect()}
    assert {i: r.api_status for i, r in got.items()} == {"a": "ok", "b": "ok", "c": "failed", "d": "ok"}
    a = got["a"].result
    assert a.category_match_strict and a.ai_purchase_name.toPython() == '球閥'
    assert str(a.ai_specifications) == "null" and str(a.ai_missing_purchase_info) == "[]"
    assert a.accepted_ground_truth_names == ["球閥"]
    assert got["b"].result.category_match_strict is False
    assert str(got["b"].result.ai_specifications) == "{}"
    header = report_header(dataset_header(data), report, "m", gated=True)
    h = header.first()
    assert (h.preflight, h.failures, h.passed, h.dataset_version) == ("passed_all_images", 1, False, "v1")
    write_eval_report(report, lambda cases: report_header(dataset_header(data), cases, "m", gated=True),
                      str(tmp_path / "out"), "json")
    written = json.loads("".join(p.read_text() for p in (tmp_path / "out/header").glob("*.json")))
    assert written["preflight"] == "passed_all_images" and written["failures"] == 1
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out/cases").glob("*.json"))
    assert text.count("\n") == 4 and "球閥" in text
    write_eval_report(report, lambda cases: header, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq/cases")).count() == 4


def test_copies_of_an_id(spark):
    cases = spark.createDataFrame([("x", 0, "old"), ("x", 1, "new"), ("y", 2, "only")],
                                  "id string, pos int, v string")
    assert [r.v for r in dataset_order(last_prepared(cases)).collect()] == ["new", "new", "only"]
    facts = spark.createDataFrame([("x", 1), ("x", 3), ("z", 9)], "id string, n int")
    joined = dataset_order(case_join(cases, facts, "f")).collect()
    assert [r.f and r.f.n for r in joined] == [3, 3, None]
    assert prepared_rows(cases, facts).count() == 2 and unprepared_rows(cases, facts).count() == 1


def test_request_status(evaluate):
    rows = [(False, False, True), (True, False, True), (True, True, False), (True, True, None),
            (True, True, True), (None, True, True)]
    got = evaluate(rows, "a boolean, b boolean, c boolean",
                   request_status(F.col("a"), F.col("b"), routing_ok=F.col("c")))
    assert got == [400, 503, 502, 502, 200, 400]


def test_side_by_side_and_defaults(evaluate):
    gt, ai = {"a": "1", "b": "2", "c": "3"}, {"a": "x", "b": None, "z": "9"}
    got = evaluate([(gt, ai), (gt, None), ({}, ai)], "g map<string,string>, a map<string,string>",
                   T.spec_side_by_side(F.col("g"), T.spec_or_empty(F.col("a"))))
    assert {k: v.ai_answer for k, v in got[0].items()} == {"a": "x", "b": None, "c": "<not provided>"}
    assert {v.ai_answer for v in got[1].values()} == {"<not provided>"} and got[2] == {}
    assert evaluate([([1],), ([],), (None,)], "x array<int>", T.nonempty(F.col("x"))) == [[1], None, None]


def test_orders_and_sources(spark, evaluate):
    assert evaluate([("u", "r"), ("", "r"), (None, "r")], "u string, r string",
                    image_source(F.col("u"), F.col("r"))) == ["u", "r", "r"]
    df = spark.createDataFrame([("grok",), ("zzz",), ("openai",), ("gemini",)], "provider string")
    assert [r[0] for r in provider_order(df).collect()] == ["gemini", "openai", "grok", "zzz"]
    both = unify_datasets(spark.range(1).selectExpr("id as a"), spark.range(1).selectExpr("id as b"))
    assert both.columns == ["a", "b"] and both.count() == 2


def test_hot_key_join_splits_and_stays_exact(spark):
    # One key holds a third of the rows, two more are over the limit, the rest are small.
    rows = spark.range(9000).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") < 3000, "hot").when(F.col("id") < 4000, "warm").when(F.col("id") < 4500, "lost")
        .otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("id"),
    )
    per_key = rows.where("id <> 'lost'").groupBy("id").agg(F.max("pos").alias("top"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = hot_key_join(rows, per_key, "id", "pos", how, share=0.01, min_rows=10)
        want = rows.join(per_key, "id", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how
    hot = hot_key_join(rows, per_key, "id", "pos", share=0.01, min_rows=10)
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan
    # The hot key is cut into ceil(3000 / 90) pieces.
    limit = 90
    spread = rows.where("id = 'hot'").select(F.pmod(F.hash("pos"), F.lit(-(-3000 // limit))).alias("p"))
    assert spread.distinct().count() == -(-3000 // limit)


def test_row_numbers(spark):
    rows = [(f"id{i % 40:02d}", i, "x" * i) for i in range(300)]
    made = spark.createDataFrame(rows, "id string, pos int, v string").repartition(5)
    for order in (["id", "pos"], ["pos"]):
        got = {(r.id, r.pos): r.row for r in numbered(made, *order).collect()}
        want = sorted(rows, key=lambda r: tuple(r[("id", "pos").index(o)] for o in order))
        assert got == {(r[0], r[1]): n for n, r in enumerate(want)}
    same = spark.createDataFrame([("a", 1)] * 50, "id string, pos int")
    assert sorted(r.row for r in numbered(same, "id").collect()) == list(range(50))
    assert numbered(same.limit(0), "id").count() == 0


def test_whole_run(spark, tmp_path):
    docs = dataset(spark, tmp_path, [case("b"), case("a"), case("c")])
    cases, header = explode_cases(docs), dataset_header(docs)
    held = images(spark, [("a", "ok", None), ("b", "failed", "empty_body")])
    landed = replies(spark, [("a", reply(GOOD)), ("b", (500, "{}"))])
    for gated, want in ((True, ["a", "b", "c"]), (False, ["b", "a", "c"])):
        report, verdict = evaluation_run(
            header, cases, held, landed, str(tmp_path / f"run-{gated}"), "m", gated, fmt="parquet")
        assert [r.id for r in report.orderBy("row").collect()] == want
        assert verdict.first().failures == (3 if gated else 2) and not verdict.first().passed
    broken = header.withColumn("policy", F.lit(None).cast(header.schema["policy"].dataType))
    with pytest.raises(ValueError, match="policy"):
        evaluation_run(broken, cases, held, landed, str(tmp_path / "never"), "m", False)
    assert not (tmp_path / "never").exists()


def test_the_last_of_several_rows_counts(spark, tmp_path):
    cases = explode_cases(dataset(spark, tmp_path, [case("a"), case("b")]))
    rows = [("a", "ok", None, 1), ("a", "failed", "gone", 2), ("b", "failed", "zz", 1), ("b", "ok", None, 2)]
    seen = spark.createDataFrame(rows, "id string, status string, error string, seq int")
    answers = [("b", *reply(GOOD), 1), ("b", 500, "{}", 2)]
    landed = spark.createDataFrame(answers, "id string, http_status int, body string, seq int")
    got = {r.id: (r.api_status, r.image.validation.error) for r in
           evaluate_isolated(cases, seen, landed, "seq").collect()}
    assert got == {"a": ("skipped", "gone"), "b": ("failed", None)}
    header = dataset_header(dataset(spark, tmp_path, [case("a"), case("b")]))
    _, verdict = evaluation_run(header, cases, seen, landed, str(tmp_path / "run"), "m", False, "seq")
    assert (verdict.first().repeated_images, verdict.first().repeated_replies) == (2, 1)


@pytest.mark.parametrize("size", ["300", "100000"])
def test_large_datasets_are_cut_into_ranges(spark, tmp_path, size):
    hints = ["} ] , { \" [", "\\", 'x\\"}', "二}", None]
    kinds = [(60, None, ""), (23, 2, "\n"), (0, None, ""), (0, 1, "\n"), (1, 1, " ")]
    for n, (count, indent, end) in enumerate(kinds):
        cases = [{**case(f"c{i}"), "image_hint": hints[i % 5]} for i in range(count)]
        doc = {"version": f"v{n}", "policy": {"ground_truth_required": True}, "cases": cases, "purpose": "p } ["}
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, ensure_ascii=n == 0, indent=indent) + end)
    for key, value in (("maxPartitionBytes", size), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        header, cases = read_large_dataset(spark, str(tmp_path))
        whole = read_eval_dataset(spark, str(tmp_path))
        want = explode_cases(whole).select(cases.drop("file").columns)
        assert Counter(map(str, cases.drop("file").collect())) == Counter(map(str, want.collect()))
        assert Counter(map(str, header.drop("file").collect())) == Counter(map(str, dataset_header(whole).collect()))
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_large_datasets_are_parsed_once(spark, tmp_path):
    from twinlabel.sources.readers import read_large_dataset as read

    (tmp_path / "a.json").write_text('{"version": "v", "cases": [{"id": "1"}, {"id": "2"}]}')
    header, cases = read(spark, str(tmp_path))
    assert [r.id for r in cases.orderBy("pos").collect()] == ["1", "2"]
    for df in (header, cases):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
