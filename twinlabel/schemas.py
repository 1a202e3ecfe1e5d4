"""Declared schemas.  Nothing is ever inferred: inference would turn the open
``specifications`` objects into one wide struct and lose absent-versus-null."""

from __future__ import annotations

import json

from .constants import IDENTIFICATION_FIELDS, ROUTING_FIELDS

GROUND_TRUTH = """struct<
  category: string, item_name: string, taiwan_purchase_name: string,
  accepted_names_zh_tw: array<string>, technical_identity_en: string,
  source_product_name: string, specifications: map<string,string>>"""

DATASET = f"""
  version string,
  purpose string,
  policy struct<generated_images_allowed: boolean, ground_truth_required: boolean,
                ground_truth_established_before_inference: boolean,
                taiwan_market_sources_preferred: boolean,
                brand_identification_required: boolean, notes: string>,
  cases array<struct<id: string, category_group: string, image_url: string,
                     source_page: string, image_hint: string, source_type: string,
                     ground_truth: {GROUND_TRUTH}>>"""

LABEL_REQUEST = """request_id string, session_id string, image_id string, provider string,
  image string, mime string, ts timestamp"""

MODEL_REPLY = "request_id string, stage string, provider string, http_status int, body string"

STORED_REPLY = "call_key string, provider string, reply_text string, error string"

PAGE = "page_id bigint, url string, html string, content_type string, image_hint string"

ROUTING = "struct<category: string, reason: string>"

IDENTIFICATION = """struct<
  identification_status: string, image_quality: string, category: string,
  item_name: string, common_names: array<string>, subtype: string, material: string,
  visible_features: array<string>,
  specifications: array<struct<label: string, value: string, evidence_level: string>>,
  most_likely_identification: string, confusable_candidate: string,
  key_differentiator: string, uncertain_fields: array<string>, typical_use: string,
  purchase_description: string, safety_note: string>"""


def _json_type(rule) -> dict:
    if rule is str:
        return {"type": "string"}
    if isinstance(rule, tuple):
        return {"type": "string", "enum": list(rule)}
    if isinstance(rule, list):
        return {"type": "array", "items": _json_type(rule[0])}
    return {
        "type": "object",
        "additionalProperties": False,
        "properties": {name: _json_type(inner) for name, inner in rule.items()},
        "required": list(rule),
    }


def json_schema(fields: dict) -> str:
    """The contract as a JSON Schema document: closed, every field required."""
    return json.dumps(_json_type(fields), ensure_ascii=False)


ROUTING_JSON_SCHEMA = json_schema(ROUTING_FIELDS)
IDENTIFICATION_JSON_SCHEMA = json_schema(IDENTIFICATION_FIELDS)
