"""Sources and sinks: what is written from the tables is read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.constants import CATEGORY_LABELS
from twinlabel.functions.replies import reply_text
from twinlabel.operators.gates import policy_gate as gate
from twinlabel.plans.comparison import result_sections
from twinlabel.plans.evaluation import evaluate_isolated, report_header
from twinlabel.plans.labelling import label_two_stage
from twinlabel.session import work_dir
from twinlabel.sources.readers import read_label_requests, read_model_replies
from twinlabel.sources.writers import write_eval_report

from .bindings import (
    CASES_SQL,
    REQUESTS_SQL,
    STUB_RESULT_SQL,
    as_requests,
    cases_and_facts,
    core_text,
    packs,
    stub_clients,
)
from .registry import query, table


@query(f"""
  SELECT doc_id, provider, CASE WHEN provider = 'other' THEN 0 ELSE length(image) END AS image_chars,
         true AS body_ok,
         provider <> 'other' AND length(image) <= 7000000
           AND regexp_full_match(image, '[A-Za-z0-9+/=]+') AS payload_ok
  FROM ({REQUESTS_SQL})""")
def read_requests(spark, sf_dir):
    """Requests landed as JSON; those of one provider carry an image that is not a string."""
    path = work_dir(spark, "requests")
    landed = as_requests(table(spark, sf_dir, "documents"))
    image = F.when(F.col("provider") == "other", F.parse_json(F.lit("[5]"))).otherwise(
        F.col("image").cast("variant")
    )
    landed.withColumn("image", image).write.json(path)
    return read_label_requests(spark, path, "json").select(
        F.col("request_id").cast("long").alias("doc_id"),
        "provider",
        F.length("image").alias("image_chars"),
        "body_ok",
        T.valid_payload(F.col("image")).alias("payload_ok"),
    )


@query("""
  SELECT conv_id || '-' || turn AS request_id, CASE WHEN turn = 0 THEN 500 ELSE 200 END AS http_status,
         CASE WHEN turn = 0 THEN 'HTTP 500: None ' || role END AS error, md5(text) AS text_md5
  FROM conversations""")
def read_replies(spark, sf_dir):
    """Reply bodies of both shapes landed as JSON, read back and reduced to their text."""
    path = work_dir(spark, "replies")
    turns = table(spark, sf_dir, "conversations")
    error = F.struct(F.col("role").alias("message")).alias("error")
    shape_g = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content")))
        .alias("candidates"), error))
    item = F.struct(F.lit("output_text").alias("type"), F.col("text"))
    shape_r = F.to_json(F.struct(
        F.array(F.struct(F.array(item).alias("content"))).alias("output"), error))
    gemini = F.col("role") == "user"
    turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.lit("1").alias("stage"),
        F.when(gemini, "gemini").otherwise("grok").alias("provider"),
        F.when(F.col("turn") == 0, 500).otherwise(200).alias("http_status"),
        F.when(gemini, shape_g).otherwise(shape_r).alias("body"),
    ).write.json(path)
    body = F.col("_body")
    return read_model_replies(spark, path, "json").withColumn(
        "_body", T.parse_json(F.col("body"))
    ).select(
        "request_id",
        "http_status",
        T.upstream_error(
            F.col("http_status"),
            F.try_variant_get(body, "$.error.code", "string"),
            F.try_variant_get(body, "$.error.message", "string"),
        ).alias("error"),
        F.md5(reply_text(F.col("provider"), body)).alias("text_md5"),
    )


@query("""
  WITH h AS (
    SELECT source, bool_or(toxic = 1) AS a, bool_and(quality = 1) AS b,
           CASE WHEN count(quality) > 20 THEN true END AS c
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
  SELECT source, concat_ws(',',
    CASE WHEN a IS DISTINCT FROM false THEN 'generated_images_allowed' END,
    CASE WHEN b IS DISTINCT FROM true THEN 'ground_truth_required' END,
    CASE WHEN c IS DISTINCT FROM true THEN 'ground_truth_established_before_inference' END)
    AS violations
  FROM h""")
def policy_gate(spark, sf_dir):
    """One policy per source, its flags true, false or missing by the labels."""
    labelled = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    policy = F.struct(
        F.bool_or(F.col("toxic") == 1).alias("generated_images_allowed"),
        F.bool_and(F.col("quality") == 1).alias("ground_truth_required"),
        F.when(F.count("quality") > 20, True).alias("ground_truth_established_before_inference"),
    )
    header = labelled.groupBy("source").agg(policy.alias("policy"))
    return gate(header).select("source", F.array_join("violations", ",").alias("violations"))


def _label_sql(column: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_LABELS.items())
    return f"CASE {column} {arms} END"


@query(f"""
  SELECT doc_id, {_label_sql('routed')} AS routed_label, {_label_sql('final')} AS final_label,
         CASE provider WHEN 'gemini' THEN 'gemini-3.7-flash' WHEN 'openai' THEN 'gpt-5.6-sol'
              ELSE 'grok-4.6' END AS names_line,
         CAST(n AS VARCHAR) AS spec_value, '可見' AS evidence_label, true AS no_uncertain_fields
  FROM ({STUB_RESULT_SQL}) WHERE status = 200""")
def result_cards(spark, sf_dir):
    """The sections shown for every labelled document; empty lists are left out."""
    labelled = label_two_stage(
        as_requests(table(spark, sf_dir, "documents")), packs(spark, sf_dir),
        core_text(spark, sf_dir), stub_clients(), work_dir(spark, "cards"),
    )
    return result_sections(labelled.where("status = 200")).select(
        F.col("request_id").cast("long").alias("doc_id"),
        "routed_label",
        "final_label",
        "names_line",
        F.get("specifications", F.lit(0))["value"].alias("spec_value"),
        F.get("specifications", F.lit(0))["evidence_label"].alias("evidence_label"),
        F.col("uncertain_fields").isNull().alias("no_uncertain_fields"),
    )


@query(f"""
  WITH c AS ({CASES_SQL}),
  s AS (SELECT CASE WHEN image_reason <> 'ok' THEN 'skipped'
                    WHEN source IN ('src1', 'src2', 'src4', 'src6', 'src7', 'src8') THEN 'failed'
                    ELSE 'ok' END AS api_status FROM c)
  SELECT 'labels-' || (SELECT count(*) FROM labels) AS dataset_version, 'stub' AS model, api_status,
         count(*) AS cases, (SELECT count(*) FROM s WHERE api_status <> 'ok') AS failures,
         (SELECT count(*) FROM s WHERE api_status <> 'ok') = 0 AS passed
  FROM s GROUP BY api_status""")
def eval_report(spark, sf_dir):
    """Header and case rows of an evaluation written as a report and read back."""
    path = work_dir(spark, "report")
    version = F.concat(F.lit("labels-"), F.count("*").cast("string")).alias("version")
    header = table(spark, sf_dir, "labels").agg(version)
    report = evaluate_isolated(*cases_and_facts(spark, sf_dir))
    write_eval_report(report, lambda cases: report_header(header, cases, "stub", gated=False), path)
    cases = spark.read.parquet(f"{path}/cases").groupBy("api_status").agg(
        F.count("*").alias("cases")
    )
    head = spark.read.parquet(f"{path}/header")
    names = ("dataset_version", "model", "failures", "passed")
    return cases.select(*[head.select(n).scalar().alias(n) for n in names], "api_status", "cases")
