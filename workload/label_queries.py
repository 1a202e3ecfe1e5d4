"""Two-stage labelling: lookups, prompts, request bodies, calls and the reroute matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.constants import CATEGORIES, CATEGORY_LABELS, LOG_TEXT_CHARS, PROVIDERS
from twinlabel.functions.prompts import TEMPLATES
from twinlabel.functions.replies import field
from twinlabel.operators.folds import reroute_matrix as matrix
from twinlabel.operators.lookups import (
    attach_category_pack,
    attach_core_pack,
    attach_labels,
    attach_provider,
    lookup_join,
    unknown_provider_rows,
)
from twinlabel.plans.labelling import build_model_requests, label_and_log, label_two_stage
from twinlabel.session import work_dir

from .bindings import (
    PACKS_SQL,
    REQUESTS_SQL,
    STUB_RESULT_SQL,
    as_provider,
    as_requests,
    core_text,
    packs,
    stub_clients,
)
from .registry import query, table


def _case_sql(column: str, table_: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


MODELS = {p[0]: p[1] for p in PROVIDERS}
PROVIDER_LABELS = {p[0]: p[2] for p in PROVIDERS}
DOC_CATEGORY_SQL = """CASE lang WHEN 'en' THEN 'fasteners' WHEN 'fr' THEN 'plumbing'
  WHEN 'de' THEN 'unknown' ELSE lang END"""


def doc_category():
    return (
        F.when(F.col("lang") == "en", "fasteners")
        .when(F.col("lang") == "fr", "plumbing")
        .when(F.col("lang") == "de", "unknown")
        .otherwise(F.col("lang"))
    )


@query(f"""
  SELECT r.doc_id, r.provider, {_case_sql('r.provider', MODELS)} AS model,
         {_case_sql('r.provider', PROVIDER_LABELS)} AS provider_label, c.category,
         {_case_sql('c.category', CATEGORY_LABELS, 'c.category')} AS category_label, p.pack,
         (SELECT min(n_name) FROM nation) AS core
  FROM ({REQUESTS_SQL}) r
  JOIN (SELECT doc_id, {DOC_CATEGORY_SQL} AS category FROM documents) c USING (doc_id)
  LEFT JOIN ({PACKS_SQL}) p ON p.category = c.category
  WHERE r.provider <> 'other'""")
def attach_packs(spark, sf_dir):
    """Provider, reference text, shared text and labels attached to every document."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select("doc_id", as_provider().alias("provider"), doc_category().alias("category"))
        .transform(attach_provider)
        .transform(attach_category_pack, packs(spark, sf_dir))
        .transform(attach_core_pack, core_text(spark, sf_dir))
        .transform(attach_labels, category="category")
        .select("doc_id", "provider", "model", "provider_label", "category", "category_label",
                "pack", "core")
    )


@query(f"SELECT doc_id, provider FROM ({REQUESTS_SQL}) WHERE provider = 'other'")
def unknown_providers(spark, sf_dir):
    """Requests whose provider is not in the table, kept apart as errors."""
    return (
        as_requests(table(spark, sf_dir, "documents"))
        .transform(unknown_provider_rows)
        .select(F.col("request_id").cast("long").alias("doc_id"), "provider")
    )


@query("""
  SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation,
         coalesce(r_name, 'none') AS region
  FROM customer
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey""")
def lookup_fallback(spark, sf_dir):
    """Label lookup with the code itself as fallback."""
    nation = (
        table(spark, sf_dir, "nation")
        .where("n_regionkey <> 2")
        .withColumnRenamed("n_nationkey", "c_nationkey")
    )
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (
        table(spark, sf_dir, "customer")
        .transform(lookup_join, nation, "c_nationkey")
        .transform(lookup_join, region, "n_regionkey")
        .select(
            "c_custkey",
            F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nation"),
            F.coalesce("r_name", F.lit("none")).alias("region"),
        )
    )


def _prompt_sql(stage: int, **slots: str) -> str:
    text = "'" + TEMPLATES[stage].replace("'", "''") + "'"
    for name, value in slots.items():
        text = f"replace({text}, '{{{{{name}}}}}', coalesce({value}, ''))"
    return text


PROMPT_SLOTS_SQL = dict(
    category="lang", reason="source", core="(SELECT min(n_name) FROM nation)", pack="text"
)


@query(f"""
  SELECT doc_id, md5({_prompt_sql(2, **PROMPT_SLOTS_SQL)}) AS prompt_md5,
         length({_prompt_sql(2, **PROMPT_SLOTS_SQL)}) AS prompt_chars
  FROM documents""")
def render_prompt(spark, sf_dir):
    """The second-stage template filled with the whole text of every document."""
    prompt = T.render_prompt(
        TEMPLATES[2], category=F.col("lang"), reason=F.col("source"), core=F.col("core"),
        pack=F.col("text"),
    )
    return (
        table(spark, sf_dir, "documents")
        .transform(attach_core_pack, core_text(spark, sf_dir))
        .select("doc_id", prompt.alias("prompt"))
        .select("doc_id", F.md5("prompt").alias("prompt_md5"),
                F.length("prompt").alias("prompt_chars"))
    )


@query(f"""
  SELECT doc_id, provider, sha256(concat_ws(E'\\n', sha256(image), provider,
           {_case_sql('provider', MODELS)}, '1', sha256({_prompt_sql(1)}), 'image/jpeg',
           sha256('{T.contract(1)}'))) AS call_key,
         {_case_sql('provider', MODELS)} AS body_model,
         md5(CASE provider WHEN 'gemini' THEN image
             ELSE 'data:image/jpeg;base64,' || image END) AS image_md5,
         md5({_prompt_sql(1)}) AS prompt_md5, 900 AS budget,
         'reason' AS last_required
  FROM ({REQUESTS_SQL})""")
def model_requests(spark, sf_dir):
    """Request bodies of both shapes for every document, read back from their JSON."""
    requests = as_requests(table(spark, sf_dir, "documents"))
    built = build_model_requests(requests, 1, T.render_prompt(TEMPLATES[1]))
    body = F.col("b")
    gemini = F.col("provider") == "gemini"

    def either(path_g, path_r, kind="string"):
        return F.when(gemini, field(body, path_g, kind)).otherwise(field(body, path_r, kind))

    return built.withColumn("b", T.parse_json(F.col("body"))).select(
        F.col("request_id").cast("long").alias("doc_id"),
        "provider",
        "call_key",
        F.when(gemini, F.col("model")).otherwise(field(body, "$.model", "string"))
        .alias("body_model"),
        F.md5(either("$.contents[0].parts[0].inline_data.data", "$.input[0].content[0].image_url"))
        .alias("image_md5"),
        F.md5(either("$.contents[0].parts[1].text", "$.input[0].content[1].text"))
        .alias("prompt_md5"),
        either("$.generationConfig.maxOutputTokens", "$.max_output_tokens", "int").alias("budget"),
        either("$.generationConfig.responseJsonSchema.required[1]",
               "$.text.format.schema.required[1]").alias("last_required"),
    )


def _label_inputs(spark, sf_dir):
    return (
        as_requests(table(spark, sf_dir, "documents")),
        packs(spark, sf_dir),
        core_text(spark, sf_dir),
        stub_clients(),
        work_dir(spark, "replies"),
    )


def _labelled(spark, sf_dir):
    return label_two_stage(*_label_inputs(spark, sf_dir))


@query(f"""
  SELECT doc_id, status, error,
         CASE WHEN status = 200 OR error LIKE 'identification%' THEN routed END AS routed_category,
         CASE WHEN status = 200 THEN final END AS final_category,
         CASE WHEN status = 200 THEN 'item ' || n END AS item_name
  FROM ({STUB_RESULT_SQL})""")
def two_stage_stub(spark, sf_dir):
    """The whole two-stage chain over all documents with a deterministic client."""
    return _labelled(spark, sf_dir).select(
        F.col("request_id").cast("long").alias("doc_id"),
        "status",
        "error",
        F.when(F.col("error").isNull() | F.startswith("error", F.lit("identification")),
               F.col("routed_category")).alias("routed_category"),
        "final_category",
        F.col("response.result.item_name").alias("item_name"),
    )


@query(f"""
  SELECT provider, routed AS routed_category,
         {', '.join(f"nullif(count(*) FILTER (final = '{c}'), 0) AS {c.replace('-', '_')}"
                    for c in CATEGORIES)}
  FROM ({STUB_RESULT_SQL}) WHERE status = 200 GROUP BY provider, routed""")
def reroute_matrix(spark, sf_dir):
    """Routed category against final category, per provider, over all labelled documents."""
    done = _labelled(spark, sf_dir).where("status = 200")
    return matrix(done, "provider")


@query(f"""
  SELECT provider, count(*) AS log_rows, max(length_ok::INT) AS within_limit
  FROM (SELECT provider, true AS length_ok FROM ({STUB_RESULT_SQL}) WHERE status = 200)
  GROUP BY provider""")
def result_log(spark, sf_dir):
    """Every result appended to the log table and read back."""
    path = work_dir(spark, "log")
    label_and_log(*_label_inputs(spark, sf_dir), log=path)
    log = spark.read.parquet(path)
    value = T.parse_json(F.col("full_text"))
    return log.groupBy(field(value, "$.provider", "string").alias("provider")).agg(
        F.count("*").alias("log_rows"),
        F.max((F.length("result_text") <= LOG_TEXT_CHARS).cast("int")).alias("within_limit"),
    )
