"""DataFrames derived from the driver's tables that several queries share.

The tables hold no photos and no model replies; requests, cases, replies and
session events are built from whole tables by Spark, so work grows with them.
Each binding has its SQL twin as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlabel.constants import CATEGORIES, PROVIDER_CODES
from twinlabel.functions import base64_line
from twinlabel.operators.lookups import literal_map

from .registry import table

# ---------------------------------------------------------------- sessions
# A user is a session and every day a new image; each tenth event belongs to the
# image of the day before, as a late reply would.
SESSION_EVENTS_SQL = """
  SELECT event_id, user_id AS session_id, ts,
         date_diff('day', TIMESTAMP '2024-01-01', ts) - (k % 10 = 0)::INT AS image_seq,
         CASE WHEN event_type = 'signup' THEN NULL
              ELSE ['gemini', 'openai', 'grok'][k % 3 + 1] END AS provider,
         CASE event_type WHEN 'signup' THEN 'image' WHEN 'purchase' THEN 'ok'
              WHEN 'error' THEN 'error' ELSE 'start' END AS kind,
         value AS result, 'e' || k AS error
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""


def as_session_events(events: DataFrame) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    kinds = {"signup": "image", "purchase": "ok", "error": "error"}
    kind = F.coalesce(F.try_element_at(literal_map(kinds), F.col("event_type")), F.lit("start"))
    providers = F.array(*[F.lit(p) for p in PROVIDER_CODES])
    return events.withColumn("k", k).select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date"))
         - F.when(F.col("k") % 10 == 0, 1).otherwise(0)).alias("image_seq"),
        F.when(F.col("event_type") != "signup", F.element_at(providers, F.col("k") % 3 + 1))
        .alias("provider"),
        kind.alias("kind"),
        F.col("value").alias("result"),
        F.concat(F.lit("e"), F.col("k")).alias("error"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_session_events(table(spark, sf_dir, "events"))


# ---------------------------------------------------------------- requests
# Every document is a request.  German texts are sent raw (bad payload) and one
# source names a provider nobody has configured.
REQUESTS_SQL = """
  SELECT doc_id, CASE WHEN lang = 'de' THEN text ELSE to_base64(encode(text)) END AS image,
         CASE WHEN source = 'src19' THEN 'other'
              ELSE ['gemini', 'openai', 'grok'][CAST(substr(source, 4) AS INT) % 3 + 1] END
           AS provider
  FROM documents"""


def as_provider() -> Column:
    """The provider that a document is sent to, by its source."""
    number = F.substring("source", 4, 9).cast("int")
    providers = F.array(*[F.lit(p) for p in PROVIDER_CODES])
    return F.when(F.col("source") == "src19", "other").otherwise(
        F.element_at(providers, number % 3 + 1)
    )


def as_requests(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.col("doc_id").cast("string").alias("image_id"),
        as_provider().alias("provider"),
        F.when(F.col("lang") == "de", F.col("text"))
        .otherwise(base64_line(F.encode("text", "UTF-8")))
        .alias("image"),
        F.lit("image/jpeg").alias("mime"),
        F.timestamp_micros(F.col("doc_id")).alias("ts"),
    )


# Reference texts: one region name per category, nothing for unknown but what
# general-repair has; the shared text is the first nation name.
PACKS_SQL = """
  SELECT ['fasteners', 'plumbing', 'electrical', 'building-hardware', 'general-repair']
           [r_regionkey + 1] AS category, r_name AS pack FROM region
  UNION ALL SELECT 'unknown', r_name FROM region WHERE r_regionkey = 4"""


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    region = table(spark, sf_dir, "region")
    known = region.select(
        F.element_at(names, F.col("r_regionkey") + 1).alias("category"), F.col("r_name").alias("text")
    )
    return known.unionByName(
        known.where("category = 'general-repair'").withColumn("category", F.lit("unknown"))
    )


def core_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").agg(F.min("n_name").alias("text"))


# ---------------------------------------------------------------- stub model
def stub_client():
    """A deterministic stand-in for a model: answers from the payload length alone."""
    import json

    def answer(request: dict) -> str:
        n = len(request["image"]) // 4
        if request["schema_name"] == "category_routing":
            if n % 7 == 0:
                return "not json"
            if n % 11 == 0:
                return json.dumps({"category": CATEGORIES[n % 6]})
            if n % 13 == 0:
                raise RuntimeError(f"no answer for {n}")
            return json.dumps({"category": CATEGORIES[n % 6], "reason": f"length {n}"})
        reply = {
            "category": CATEGORIES[n // 6 % 6],
            "item_name": f"item {n}",
            "most_likely_identification": request["provider"],
            "purchase_description": "-",
            "common_names": [request["model"]],
            "visible_features": [],
            "specifications": [
                {"label": "length", "value": str(n), "evidence_level": "observed"}
            ],
            "uncertain_fields": [],
        }
        if n % 17 == 0:
            del reply["item_name"]
        return json.dumps(reply)

    return answer


def stub_clients() -> dict:
    return {p: stub_client for p in PROVIDER_CODES}


STUB_RESULT_SQL = f"""
  SELECT doc_id, provider,
    CASE WHEN NOT regexp_full_match(image, '[A-Za-z0-9+/=]+') THEN 400
         WHEN provider = 'other' THEN 503
         WHEN n % 7 = 0 OR n % 11 = 0 OR n % 13 = 0 OR n % 17 = 0 THEN 502 ELSE 200 END AS status,
    CASE WHEN NOT regexp_full_match(image, '[A-Za-z0-9+/=]+') THEN 'bad_payload'
         WHEN provider = 'other' THEN 'provider_not_configured'
         WHEN n % 7 = 0 THEN 'routing: bad_json'
         WHEN n % 11 = 0 THEN 'routing: incomplete_reply'
         WHEN n % 13 = 0 THEN 'routing: call_failed: RuntimeError: no answer for ' || n
         WHEN n % 17 = 0 THEN 'identification: incomplete_reply' END AS error,
    {list(CATEGORIES)}[n % 6 + 1] AS routed, {list(CATEGORIES)}[n // 6 % 6 + 1] AS final, n
  FROM (SELECT *, length(image) // 4 AS n FROM ({REQUESTS_SQL}))"""


# ---------------------------------------------------------------- cases
# Every labelled document is a case; images pass from 200 characters on, one
# source stands for a wrong content type.  Replies are bodies in shape R.
CASES_SQL = """
  SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic,
         CASE WHEN n_chars < 200 THEN 'too_small' WHEN source = 'src18' THEN 'not_an_image'
              ELSE 'ok' END AS image_reason
  FROM documents d JOIN labels l USING (doc_id)"""


def cases_and_facts(spark: SparkSession, sf_dir: str):
    """cases, image observations and landed replies of the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    key = F.col("doc_id").cast("string").alias("id")
    truth = F.struct(
        F.when(F.col("quality") == 1, "building-hardware").otherwise("general-repair")
        .alias("category"),
        F.concat_ws(" ", "lang", "source", F.lit("item")).alias("item_name"),
        F.concat_ws(" ", "lang", "source").alias("taiwan_purchase_name"),
        F.array("lang").alias("accepted_names_zh_tw"),
        F.create_map(
            F.lit("language"), F.col("lang"), F.lit("origin"), F.col("source"),
            F.lit("toxic"), F.col("toxic").cast("string"),
        ).alias("specifications"),
    )
    cases = labelled.select(
        key,
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://img.example/"), "doc_id").alias("image_url"),
        F.concat(F.lit("https://page.example/"), "doc_id").alias("source_page"),
        F.col("lang").alias("category_group"),
        F.col("source").alias("source_type"),
        truth.alias("ground_truth"),
    )
    reason = (
        F.when(F.col("n_chars") < 200, "too_small")
        .when(F.col("source") == "src18", "not_an_image")
        .otherwise("ok")
    )
    images = docs.select(
        key,
        F.when(reason == "ok", "ok").otherwise("failed").alias("status"),
        F.when(reason != "ok", reason).alias("error"),
        F.col("n_chars").alias("original_bytes"),
        F.concat(F.lit("https://img.example/"), "doc_id").alias("resolved_url"),
    )
    # Answers: a guess at the category from the length, and broken ones by source.
    answer = F.struct(
        F.when(F.col("n_chars") > 600, "Building_Hardware").otherwise("general  repair")
        .alias("category"),
        F.concat_ws(" ", "lang", F.lit("thing")).alias("item_name"),
        F.col("lang").alias("item_name_zh_tw"),
        F.struct(F.col("lang").alias("language"), F.col("source").alias("extra"))
        .alias("specifications"),
    )
    good = F.to_json(F.struct(answer.alias("answer")))
    text = (
        F.when(F.col("source") == "src1", "[1]")
        .when(F.col("source") == "src2", '{"answer": null}')
        .when(F.col("source") == "src3", '{"diagnostic": {}}')
        .when(F.col("source") == "src4", "not json")
        .when(F.col("source") == "src5", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(F.col("source") == "src6", '{"answer": {"specifications": "none"}}')
        .otherwise(good)
    )
    item = F.struct(F.lit("output_text").alias("type"), text.alias("text"))
    replies = docs.select(
        key,
        F.when(F.col("source") == "src7", 502).when(F.col("source") == "src8", 429).otherwise(200)
        .alias("http_status"),
        F.when(F.col("source") == "src7", "<html>bad gateway</html>")
        .when(F.col("source") == "src8", '{"error":{"code":"busy","message":"later"}}')
        .otherwise(
            F.to_json(F.struct(F.array(F.struct(F.array(item).alias("content"))).alias("output")))
        )
        .alias("body"),
    )
    return cases, images, replies


def as_passed(images: DataFrame) -> DataFrame:
    """The observations of images that all pass."""
    return images.withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
