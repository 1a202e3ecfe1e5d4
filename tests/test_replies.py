import json

from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.functions.replies import answer_or_empty, python_text
from twinlabel.operators.guards import (
    consistency_violations,
    guard_identification,
    guard_routing,
    is_category,
    routing_violations,
    schema_violations,
)
from twinlabel.schemas import IDENTIFICATION, IDENTIFICATION_JSON_SCHEMA

X = F.col("x")
V = T.parse_json(X)


def test_parse_structured(evaluate):
    rows = [None, "", "  \n", "﻿", "nope", "NaN", "5", "[1]", "null", '{"a":1,"a":2}',
            '{"a":1} trailing', '{"a":1}{', "1]", '{"a":1}\n', "1,2"]
    got = evaluate(rows, "x string", T.parse_status(X, V), F.to_json(V))
    assert [g[0] for g in got] == (
        ["empty_reply"] * 4 + ["bad_json"] * 2 + ["ok"] * 4 + ["bad_json"] * 3 + ["ok", "bad_json"])
    assert got[9][1] == '{"a":2}'


def test_guard_routing(evaluate):
    good = {"category": "plumbing", "reason": ""}
    rows = [good, {**good, "x": 1}, {**good, "category": "Plumbing"}, {**good, "category": 5},
            {**good, "reason": 5}, {**good, "reason": None}, {"category": "plumbing"}, [good], None,
            "plumbing"]
    got = evaluate([json.dumps(r) for r in rows], "x string", guard_routing(V), routing_violations(V))
    assert [g[0] for g in got] == [True, True] + [False] * 8
    assert got[0][1] == [] and got[1][1] == ["extra:x"] and got[2][1] == ["enum:category"]
    assert got[3][1] == ["type:category"] and got[4][1] == ["type:reason"]
    assert got[6][1] == ["missing:reason"] and got[7][1] == ["not_an_object"]


FULL = {
    "identification_status": "identified", "image_quality": "good", "category": "fasteners",
    "item_name": "bolt", "common_names": ["bolt"], "subtype": "", "material": "", "visible_features": [],
    "specifications": [{"label": "d", "value": "8", "evidence_level": "observed"}],
    "most_likely_identification": "bolt", "confusable_candidate": "screw", "key_differentiator": "",
    "uncertain_fields": [], "typical_use": "", "purchase_description": "", "safety_note": "",
}


def test_guard_identification(evaluate):
    def without(*names):
        return {k: v for k, v in FULL.items() if k not in names}

    spec = FULL["specifications"][0]
    rows = [
        (FULL, True, []),
        (without("subtype", "safety_note"), True, ["missing:subtype", "missing:safety_note"]),
        ({**FULL, "common_names": [1, None]}, True, ["type:common_names"]),
        ({**FULL, "common_names": "bolt"}, False, ["type:common_names"]),
        ({**FULL, "specifications": {}}, False, ["type:specifications"]),
        ({**FULL, "specifications": [{**spec, "evidence_level": "seen"}]}, True, ["item:specifications"]),
        ({**FULL, "specifications": [{**spec, "more": 1}]}, True, ["item:specifications"]),
        ({**FULL, "specifications": ["x"]}, True, ["item:specifications"]),
        ({**FULL, "item_name": None}, False, ["type:item_name"]),
        ({**FULL, "image_quality": "fine", "z": 1, "b": 2}, True, ["enum:image_quality", "extra:b",
                                                                "extra:z"]),
        (without("category"), False, ["missing:category"]),
        ([FULL], False, ["not_an_object"]),
    ]
    got = evaluate([json.dumps(r[0]) for r in rows], "x string", guard_identification(V),
                   schema_violations(V))
    assert got == [(ok, codes) for _, ok, codes in rows]


def test_consistency(evaluate):
    spec = {"label": "a", "value": "", "evidence_level": "unconfirmed"}
    rows = [
        (FULL, []),
        ({**FULL, "image_quality": "unusable"}, ["quality_status_mismatch", "unusable_without_reason"]),
        ({**FULL, "image_quality": "unusable", "identification_status": "unidentifiable",
          "uncertain_fields": ["dark"]}, []),
        ({**FULL, "identification_status": "unidentifiable"}, ["quality_status_mismatch"]),
        ({**FULL, "specifications": [spec], "confusable_candidate": ""},
         ["unconfirmed_without_value", "no_confusable_candidate"]),
    ]
    got = evaluate([json.dumps(r[0]) for r in rows], "x string",
                   consistency_violations(F.from_json(X, IDENTIFICATION)))
    assert got == [codes for _, codes in rows]


def test_is_category(evaluate):
    assert evaluate(["unknown", "Unknown", None], "x string", is_category(X)) == [True, False, False]


def test_contract_is_closed():
    schema = json.loads(IDENTIFICATION_JSON_SCHEMA)
    assert len(schema["required"]) == 16 and schema["additionalProperties"] is False
    items = schema["properties"]["specifications"]["items"]
    assert items["additionalProperties"] is False and len(items["required"]) == 3


def test_first_text_part(evaluate):
    def body(*parts):
        return json.dumps({"candidates": [{"content": {"parts": list(parts)}}]})

    rows = [body({"thought": True}, {"text": "a"}, {"text": "b"}), body({"text": 5}), "{}",
            '{"candidates":[]}', body()]
    assert evaluate(rows, "x string", T.first_text_part(V)) == ["a", None, None, None, None]


def test_output_texts(evaluate):
    def out(*contents):
        return json.dumps({"output": [{"content": c} for c in contents]})

    a, b = {"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}
    other = {"type": "reasoning", "text": "x"}
    rows = [
        (out([other, a], [b]), "a", "ab"),
        (out(None, [a]), "a", None),
        ('{"output":[{},{"content":[]}]}', None, ""),
        ("{}", None, ""),
        ('{"output":null}', None, None),
        ("[1]", None, None),
        (out([{"type": "output_text"}], [a]), None, "a"),
        (out([{"type": "output_text", "text": 5}]), None, None),
        (out(["x", a]), "a", None),
    ]
    got = evaluate([r[0] for r in rows], "x string", T.first_output_text(V), T.all_output_text(V))
    assert got == [r[1:] for r in rows]


def test_answer_or_empty(evaluate):
    rows = ['{"answer":{"a":1}}', '{"answer":null}', "{}", '{"answer":[]}', '{"answer":5}', "[]", "null",
            '{"answer":""}', '{"answer":"x"}', '{"answer":0}', '{"answer":false}']
    keys = lambda m: F.array_join(F.map_keys(m), ",")
    got = evaluate(rows, "x string", keys(answer_or_empty(V, True)), keys(answer_or_empty(V, False)))
    assert got == [("a", "a"), ("", None), ("", ""), ("", None), (None, None), (None, None),
                   (None, None), ("", None), (None, None), ("", None), ("", None)]


def test_python_text(evaluate):
    rows = ['"a"', "5", "0", "0.0", "true", "false", "null", "[]", "{}", '""', "1.5"]
    assert evaluate(rows, "x string", python_text(V)) == [
        "a", "5", "", "", "True", "", "", "", "", "", "1.5"]
