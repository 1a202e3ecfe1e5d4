"""Payload, hash, text and JSON functions over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.functions.replies import field
from twinlabel.functions.text import token_set
from twinlabel.operators.gates import request_status as status_of
from twinlabel.operators.guards import (
    consistency_violations,
    guard_identification as identification_guard,
    guard_routing as routing_guard,
    routing_violations,
    schema_violations,
)
from twinlabel.constants import (
    CATEGORIES,
    IDENTIFICATION_FIELDS,
)
from twinlabel.schemas import IDENTIFICATION

from .registry import query, sql_norm, sql_tokens, table

# ---------------------------------------------------------------- payloads
PAYLOAD_LIMIT = 4000


@query(f"""
  SELECT doc_id, length(b) AS payload_chars,
         length(b) BETWEEN 1 AND {PAYLOAD_LIMIT} AND regexp_full_match(b, '[A-Za-z0-9+/=]+')
           AS payload_ok,
         length(text) BETWEEN 1 AND {PAYLOAD_LIMIT} AND regexp_full_match(text, '[A-Za-z0-9+/=]+')
           AS raw_ok,
         md5('data:image/jpeg;base64,' || b) AS url_md5
  FROM (SELECT doc_id, text, to_base64(encode(text)) AS b FROM documents)""")
def payload_valid(spark, sf_dir):
    """Payload check on the base64 of every text and on the raw text; the limit is lowered
    so that both outcomes occur."""
    payload = T.base64_line(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", payload.alias("b")).select(
        "doc_id",
        F.length("b").alias("payload_chars"),
        T.valid_payload(F.col("b"), PAYLOAD_LIMIT).alias("payload_ok"),
        T.valid_payload(F.col("text"), PAYLOAD_LIMIT).alias("raw_ok"),
        F.md5(T.data_url(F.lit("image/jpeg"), F.col("b"))).alias("url_md5"),
    )


@query("""
  SELECT doc_id,
         CASE WHEN NOT regexp_full_match(payload, '[A-Za-z0-9+/=]+')
                   OR length(payload) NOT BETWEEN 1 AND 7000000 THEN 400
              WHEN source IN ('src0', 'src5', 'src9') THEN 503
              WHEN n_chars < 300 OR n_chars > 3000 THEN 502
              ELSE 200 END AS status
  FROM (SELECT doc_id, source, n_chars,
               CASE WHEN lang = 'de' THEN text ELSE to_base64(encode(text)) END AS payload
        FROM documents)""")
def request_status(spark, sf_dir):
    """First failure wins: raw texts are bad payloads, three sources lack a provider, and
    very short or long texts stand for failed stages."""
    docs = table(spark, sf_dir, "documents")
    payload = F.when(F.col("lang") == "de", F.col("text")).otherwise(
        T.base64_line(F.encode("text", "UTF-8"))
    )
    return docs.withColumn("payload", payload).select(
        "doc_id",
        status_of(
            T.valid_payload(F.col("payload")),
            ~F.col("source").isin("src0", "src5", "src9"),
            routing_ok=F.col("n_chars") >= 300,
            identification_ok=F.col("n_chars") <= 3000,
        ).alias("status"),
    )


@query("""
  SELECT doc_id, sha256(text) AS text_sha256, substr(sha256(text), 1, 12) AS short_hash,
         octet_length(encode(text)) AS text_bytes
  FROM documents""")
def hash_and_size(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.sha256(content).alias("text_sha256"),
        T.truncate_text(T.sha256(content), 12).alias("short_hash"),
        T.byte_length(content).alias("text_bytes"),
    )


@query("""
  SELECT doc_id, md5(text) AS text_md5,
         md5(coalesce(left(text, 1), '') || chr(65533) || text) AS broken_md5
  FROM documents""")
def decode_text(spark, sf_dir):
    """Bytes to text; a stray continuation byte becomes one replacement character."""
    good = F.encode("text", "UTF-8")
    first = F.encode(F.substring("text", 1, 1), "UTF-8")
    broken = F.concat(first, F.unhex(F.lit("80")), good)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(T.decode_utf8_replace(good)).alias("text_md5"),
        F.md5(T.decode_utf8_replace(broken)).alias("broken_md5"),
    )


# ---------------------------------------------------------------- text
@query(f"SELECT doc_id, md5({sql_norm('text')}) AS norm_md5 FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.norm(F.col("text"))).alias("norm_md5")
    )


@query(f"""
  WITH named AS (
    SELECT d.doc_id, b.item_id, {sql_tokens('b.text')} AS expected, {sql_tokens('d.text')} AS answer
    FROM documents d JOIN benchmark b
      ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
  SELECT doc_id, item_id, len(list_intersect(expected, answer)) AS shared,
         least(len(expected), len(answer)) AS smaller,
         least(len(expected), len(answer)) > 0
           AND len(list_intersect(expected, answer)) / least(len(expected), len(answer)) >= 0.5
           AS name_match
  FROM named""")
def item_name_match(spark, sf_dir):
    """Every document paired with one benchmark item; token overlap of the whole texts."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark")
    expected = items.select("item_id", token_set(F.col("text")).alias("expected"))
    count = items.agg(F.count("*").alias("n")).scalar()
    answers = docs.select(
        "doc_id",
        (F.col("doc_id") % count).alias("item_id"),
        token_set(F.col("text")).alias("answer"),
    )
    shared = F.size(T.token_intersection(F.col("expected"), F.col("answer")))
    return answers.join(expected, "item_id").select(
        "doc_id",
        "item_id",
        shared.alias("shared"),
        F.least(F.size("expected"), F.size("answer")).alias("smaller"),
        T.token_overlap_match(F.col("expected"), F.col("answer")).alias("name_match"),
    )


@query(r"""
  SELECT doc_id, md5(trim(text, E' \n')) AS plain_md5,
         substr(text, 1, 12000) AS log_text, length(text) AS full_chars
  FROM documents""")
def log_truncate(spark, sf_dir):
    """Fences are put around every text and taken off again; log text is cut to its limit."""
    docs = table(spark, sf_dir, "documents")
    fenced = (
        F.when(F.col("source") == "src1", F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(F.col("source") == "src2", F.concat(F.lit(" ```\n"), "text", F.lit("```\n")))
        .when(F.col("source") == "src3", F.concat("text", F.lit("\n```")))
        .otherwise(F.concat(F.lit("\n "), "text", F.lit(" \n")))
    )
    return docs.select(
        "doc_id",
        F.md5(T.strip_code_fence(fenced)).alias("plain_md5"),
        T.truncate_text(F.col("text"), 12000).alias("log_text"),
        F.length("text").alias("full_chars"),
    )


# ---------------------------------------------------------------- JSON
@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", field(T.parse_json(F.col("props")), "$.k", "bigint").alias("k")
    )


ROUTING_REPLY_SQL = """
  SELECT doc_id,
    CASE source
      WHEN 'src0' THEN left(j, length(j) - 1)
      WHEN 'src1' THEN CAST(json_object('category', 5, 'reason', text) AS VARCHAR)
      WHEN 'src2' THEN CAST(json_object('category', 'plumbing') AS VARCHAR)
      WHEN 'src3' THEN '[' || j || ']'
      WHEN 'src4' THEN '  '
      WHEN 'src5' THEN CAST(json_object('category', 'plumbing', 'reason', n_chars) AS VARCHAR)
      WHEN 'src6' THEN 'null'
      WHEN 'src7' THEN CAST(json_object('category', 'plumbing', 'reason', text, 'more', 1)
                            AS VARCHAR)
      ELSE j END AS reply
  FROM (SELECT *, CAST(json_object('category', CASE lang WHEN 'en' THEN 'fasteners'
                          WHEN 'fr' THEN 'electrical' WHEN 'es' THEN 'unknown'
                          ELSE 'Plumbing' END, 'reason', text) AS VARCHAR) AS j
        FROM documents)"""


@query(f"""
  WITH r AS ({ROUTING_REPLY_SQL}),
  p AS (SELECT doc_id, reply, trim(reply) = '' AS blank, json_valid(reply) AS valid,
               CASE WHEN json_valid(reply) THEN reply ELSE 'null' END AS j FROM r),
  g AS (SELECT doc_id, blank, valid, json_type(j) AS kind, json_type(j, '$.category') AS ck,
               json_extract_string(j, '$.category') AS c, json_type(j, '$.reason') AS rk,
               CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) ELSE [] END AS keys
        FROM p)
  SELECT doc_id,
         CASE WHEN blank THEN 'empty_reply' WHEN NOT valid THEN 'bad_json'
              WHEN coalesce(ck = 'VARCHAR' AND rk = 'VARCHAR' AND c IN
                   ('fasteners','plumbing','electrical','building-hardware','general-repair',
                    'unknown'), false) THEN 'ok'
              ELSE 'incomplete_reply' END AS status,
         CASE WHEN blank OR NOT valid THEN NULL
              WHEN kind <> 'OBJECT' THEN 'not_an_object'
              ELSE concat_ws(',',
                CASE WHEN ck IS NULL THEN 'missing:category' WHEN ck <> 'VARCHAR'
                     THEN 'type:category' WHEN c NOT IN
                     ('fasteners','plumbing','electrical','building-hardware','general-repair',
                      'unknown') THEN 'enum:category' END,
                CASE WHEN rk IS NULL THEN 'missing:reason' WHEN rk <> 'VARCHAR'
                     THEN 'type:reason' END,
                CASE WHEN list_contains(keys, 'more') THEN 'extra:more' END) END AS violations
  FROM g""")
def guard_routing(spark, sf_dir):
    """Routing replies built from the documents, broken in eight ways by source."""
    docs = table(spark, sf_dir, "documents")
    category = (
        F.when(F.col("lang") == "en", "fasteners")
        .when(F.col("lang") == "fr", "electrical")
        .when(F.col("lang") == "es", "unknown")
        .otherwise("Plumbing")
    )
    whole = F.to_json(F.struct(category.alias("category"), F.col("text").alias("reason")))
    plumbing = F.lit("plumbing").alias("category")

    def when(chain, source, value):
        return chain.when(F.col("source") == source, value)

    reply = F.when(F.col("source") == "src0", F.expr("left(whole, length(whole) - 1)"))
    reply = when(reply, "src1", F.to_json(F.struct(F.lit(5).alias("category"),
                                                   F.col("text").alias("reason"))))
    reply = when(reply, "src2", F.to_json(F.struct(plumbing)))
    reply = when(reply, "src3", F.concat(F.lit("["), "whole", F.lit("]")))
    reply = when(reply, "src4", F.lit("  "))
    reply = when(reply, "src5", F.to_json(F.struct(plumbing, F.col("n_chars").alias("reason"))))
    reply = when(reply, "src6", F.lit("null"))
    reply = when(reply, "src7", F.to_json(F.struct(plumbing, F.col("text").alias("reason"),
                                                   F.lit(1).alias("more"))))
    value = F.col("value")
    return (
        docs.withColumn("whole", whole)
        .select("doc_id", reply.otherwise(F.col("whole")).alias("reply"))
        .withColumn("value", T.parse_json(F.col("reply")))
        .withColumn("parsed", T.parse_status(F.col("reply"), value))
        .select(
            "doc_id",
            F.when(F.col("parsed") != "ok", F.col("parsed"))
            .when(routing_guard(value), "ok")
            .otherwise("incomplete_reply")
            .alias("status"),
            F.when(F.col("parsed") == "ok", F.array_join(routing_violations(value), ","))
            .alias("violations"),
        )
    )


def _sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _violation_sql(rules: dict) -> str:
    """The contract check in SQL, one CASE per field of the contract."""
    out = []
    for name, rule in rules.items():
        kind = f"json_type(j, '$.{name}')"
        case = f"CASE WHEN {kind} IS NULL THEN 'missing:{name}' "
        if isinstance(rule, list):
            items = f"json_extract(j, '$.{name}[*]')"
            bad = f"{kind} <> 'ARRAY'"
            if rule[0] is str:
                bad += f" OR len(list_filter({items}, lambda i: json_type(i) <> 'VARCHAR')) > 0"
                case += f"WHEN {bad} THEN 'type:{name}' "
            else:
                case += (
                    f"WHEN {bad} THEN 'type:{name}' "
                    f"WHEN len(list_filter({items}, lambda i: NOT coalesce("
                    "json_type(i) = 'OBJECT' AND len(json_keys(i)) = 3"
                    " AND json_type(i, '$.label') = 'VARCHAR' AND json_type(i, '$.value') = 'VARCHAR'"
                    " AND json_extract_string(i, '$.evidence_level')"
                    " IN ('observed', 'estimated', 'unconfirmed'), false))) > 0"
                    f" THEN 'item:{name}' "
                )
        else:
            case += f"WHEN {kind} <> 'VARCHAR' THEN 'type:{name}' "
            if isinstance(rule, tuple):
                case += (f"WHEN json_extract_string(j, '$.{name}') NOT IN {_sql_list(rule)}"
                         f" THEN 'enum:{name}' ")
        out.append(case + "END")
    return ",\n".join(out)


# Field values of the replies: (field, value in Spark SQL, value in the oracle's SQL).
# Sources break one field each; n_chars and lang steer the rest.
_REPLY = [
    ("identification_status",
     "CASE WHEN n_chars < 200 THEN 'unidentifiable' WHEN source = 'src8' THEN 'maybe' "
     "ELSE 'identified' END"),
    ("image_quality", "CASE WHEN n_chars < 250 THEN 'unusable' ELSE 'good' END"),
    ("category", "CASE WHEN lang = 'de' THEN 'Electrical' ELSE 'electrical' END"),
    ("item_name", "CASE WHEN source <> 'src9' THEN source END"),
    ("subtype", "CASE WHEN source <> 'src10' THEN lang END"),
    ("material", "lang"),
    ("most_likely_identification", "text"),
    ("confusable_candidate", "CASE WHEN source = 'src13' THEN '' ELSE 'none' END"),
    ("key_differentiator", "'-'"),
    ("typical_use", "'-'"),
    ("purchase_description", "source || ' ' || lang"),
    ("safety_note", "'-'"),
]
_LEVEL = ("CASE WHEN source = 'src14' THEN 'seen' WHEN n_chars > 1000 THEN 'unconfirmed' "
          "ELSE 'observed' END")
_VALUE = "CASE WHEN source = 'src15' THEN '' ELSE 'v' END"


def _reply_sql() -> str:
    parts = [f"'{name}', {value}" for name, value in _REPLY]
    parts.append("'common_names', json_array(source, lang)")
    parts.append("'visible_features', CASE WHEN source = 'src11' THEN to_json(text) "
                 "ELSE to_json(string_split(text, E'\\n')) END")
    parts.append(f"'specifications', json_array(json_object('label', lang, 'value', {_VALUE}, "
                 f"'evidence_level', {_LEVEL}))")
    parts.append("'uncertain_fields', CASE WHEN source = 'src12' THEN to_json([1]) "
                 "WHEN n_chars < 150 THEN to_json([]::VARCHAR[]) ELSE to_json(['size']) END")
    # JSON null fields are left out, as Spark's to_json leaves them out.
    return f"""SELECT doc_id, json_merge_patch('{{}}'::JSON, json_object({', '.join(parts)})) AS j
               FROM documents"""


@query(f"""
  WITH r AS ({_reply_sql()})
  SELECT doc_id,
    coalesce(json_extract_string(j, '$.category') IN {_sql_list(CATEGORIES)}
      AND json_type(j, '$.item_name') = 'VARCHAR'
      AND json_type(j, '$.most_likely_identification') = 'VARCHAR'
      AND json_type(j, '$.purchase_description') = 'VARCHAR'
      AND json_type(j, '$.common_names') = 'ARRAY' AND json_type(j, '$.visible_features') = 'ARRAY'
      AND json_type(j, '$.specifications') = 'ARRAY'
      AND json_type(j, '$.uncertain_fields') = 'ARRAY', false) AS usable,
    concat_ws(',', {_violation_sql(IDENTIFICATION_FIELDS)}) AS violations,
    concat_ws(',',
      CASE WHEN (json_extract_string(j, '$.image_quality') = 'unusable')
             <> (json_extract_string(j, '$.identification_status') = 'unidentifiable')
           THEN 'quality_status_mismatch' END,
      CASE WHEN json_extract_string(j, '$.image_quality') = 'unusable'
             AND json_array_length(j, '$.uncertain_fields') = 0 THEN 'unusable_without_reason' END,
      CASE WHEN json_extract_string(j, '$.specifications[0].evidence_level') = 'unconfirmed'
             AND json_extract_string(j, '$.specifications[0].value') = ''
           THEN 'unconfirmed_without_value' END,
      CASE WHEN json_extract_string(j, '$.confusable_candidate') = ''
           THEN 'no_confusable_candidate' END) AS inconsistencies
  FROM r""")
def guard_identification(spark, sf_dir):
    """Identification replies from the documents: guard, full contract, consistency."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    uncertain = (
        F.when(F.col("source") == "src12", F.parse_json(F.lit("[1]")))
        .when(F.col("n_chars") < 150, F.parse_json(F.lit("[]")))
        .otherwise(F.parse_json(F.lit('["size"]')))
    )
    fields = [F.expr(value).alias(name) for name, value in _REPLY]
    fields += [
        F.array("source", "lang").alias("common_names"),
        F.when(F.col("source") == "src11", F.col("text").cast("variant"))
        .otherwise(F.to_variant_object(lines))
        .alias("visible_features"),
        F.array(
            F.struct(F.col("lang").alias("label"), F.expr(_VALUE).alias("value"),
                     F.expr(_LEVEL).alias("evidence_level"))
        ).alias("specifications"),
        uncertain.alias("uncertain_fields"),
    ]
    value = F.col("value")
    typed = F.from_json(F.col("reply"), IDENTIFICATION)
    return (
        docs.select("doc_id", F.to_json(F.struct(*fields)).alias("reply"))
        .withColumns({"value": T.parse_json(F.col("reply")), "typed": typed})
        .select(
            "doc_id",
            identification_guard(value).alias("usable"),
            F.array_join(schema_violations(value), ",").alias("violations"),
            F.array_join(consistency_violations(F.col("typed")), ",").alias("inconsistencies"),
        )
    )


@query("""
  WITH b AS (
    SELECT conv_id, turn,
      json_object('candidates', json_array(json_object('content', json_object('parts',
        json_array(json_object('thought', true), json_object('text', 7),
                   json_object('text', text), json_object('text', role)))))) AS g,
      CASE WHEN role = 'system' THEN
        json_object('output', json_array(json_object('content', NULL),
          json_object('content', json_array(json_object('type', 'output_text', 'text', text)))))
      ELSE json_object('output', json_array(
          json_object('content', json_array(json_object('type', 'reasoning', 'text', 'x'),
                                            json_object('type', 'output_text', 'text', text))),
          json_object('kind', 'empty'),
          json_object('content', json_array(json_object('type', 'output_text', 'text', role)))))
      END AS r
    FROM conversations),
  e AS (
    SELECT conv_id, turn, r,
      list_filter(json_extract(g, '$.candidates[0].content.parts[*].text'),
                  lambda t: json_type(t) = 'VARCHAR') AS parts,
      list_filter(json_extract(r, '$.output[*].content[*]'),
                  lambda i: json_extract_string(i, '$.type') = 'output_text') AS items
    FROM b)
  SELECT conv_id, turn, md5(json_extract_string(parts[1], '$')) AS part_md5,
         md5(json_extract_string(items[1], '$.text')) AS first_md5,
         CASE WHEN json_type(r, '$.output[0].content') = 'NULL' THEN NULL
              ELSE md5(array_to_string(
                list_transform(items, lambda i: json_extract_string(i, '$.text')), '')) END
           AS joined_md5
  FROM e""")
def reply_text(spark, sf_dir):
    """Reply bodies of both shapes built from every turn, their texts extracted again."""
    turns = table(spark, sf_dir, "conversations")

    def item(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    text, role = F.col("text"), F.col("role")
    shape_g = F.concat(
        F.lit('{"candidates":[{"content":{"parts":[{"thought":true},{"text":7},'),
        F.to_json(F.struct(text.alias("text"))), F.lit(","),
        F.to_json(F.struct(role.alias("text"))), F.lit("]}}]}"),
    )
    system = F.concat(
        F.lit('{"output":[{"content":null},{"content":'),
        F.to_json(F.array(item("output_text", text))), F.lit("}]}"),
    )
    other = F.concat(
        F.lit('{"output":[{"content":'),
        F.to_json(F.array(item("reasoning", F.lit("x")), item("output_text", text))),
        F.lit('},{"kind":"empty"},{"content":'),
        F.to_json(F.array(item("output_text", role))), F.lit("}]}"),
    )
    bodies = turns.select(
        "conv_id", "turn",
        T.parse_json(shape_g).alias("g"),
        T.parse_json(F.when(role == "system", system).otherwise(other)).alias("r"),
    )
    return bodies.select(
        "conv_id", "turn",
        F.md5(T.first_text_part(F.col("g"))).alias("part_md5"),
        F.md5(T.first_output_text(F.col("r"))).alias("first_md5"),
        F.md5(T.all_output_text(F.col("r"))).alias("joined_md5"),
    )

