"""Evaluation: gates, comparison with ground truth, joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel.functions import image_acceptance as acceptance
from twinlabel.functions import spec_side_by_side as side_by_side
from twinlabel.functions import target_size as scaled
from twinlabel.functions.images import final_format, final_mime, needs_conversion
from twinlabel.functions.text import join_names, media_type
from twinlabel.operators import folds
from twinlabel.operators.gates import failed_rows
from twinlabel.operators.gates import ground_truth_gate as truth_gate
from twinlabel.operators.joins import (
    case_join as join_facts,
    global_gate as gate,
    last_prepared as last_of_id,
    prepared_rows,
    spec_join as join_specs,
    unprepared_rows,
)
from twinlabel.operators.nested import explode_items
from twinlabel.operators.reports import merge_failed_and_prepared, unify_datasets
from twinlabel.plans.evaluation import evaluate_gated, evaluate_isolated

from .bindings import CASES_SQL, as_passed, cases_and_facts
from .registry import query, table

# ---------------------------------------------------------------- specifications
_PART_SPECS_SQL = """
  SELECT p_partkey, 'brand' AS field, p_brand AS ground_truth, p_brand AS ai_answer FROM part
  UNION ALL
  SELECT p_partkey, 'type', p_type, CASE WHEN p_size > 25 THEN NULL ELSE lower(p_type) END FROM part
  UNION ALL
  SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), '<not provided>' FROM part"""


def _part_specs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.create_map(
            F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"),
            F.lit("size"), F.col("p_size").cast("string"),
        ).alias("gt"),
        F.create_map(
            F.lit("type"), F.when(F.col("p_size") <= 25, F.lower("p_type")),
            F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"),
        ).alias("ai"),
    )


@query(_PART_SPECS_SQL)
def spec_side_by_side(spark, sf_dir):
    """Absent reads as such, a null answer stays null, extra answers are left out."""
    compared = _part_specs(spark, sf_dir).select(
        "p_partkey", F.explode(side_by_side(F.col("gt"), F.col("ai"))).alias("field", "v")
    )
    return compared.select("p_partkey", "field", "v.ground_truth", "v.ai_answer")


@query(f"""
  SELECT p_partkey, field, ground_truth, CASE WHEN field <> 'size' THEN ai_answer END AS ai_answer,
         field <> 'size' AS provided FROM ({_PART_SPECS_SQL})""")
def spec_join(spark, sf_dir):
    """The same comparison as a join on (id, field)."""
    specs = _part_specs(spark, sf_dir)
    return join_specs(specs, specs, "gt", "ai", key="p_partkey")


# ---------------------------------------------------------------- gates
@query("""
  SELECT doc_id,
         CASE WHEN (SELECT bool_and(n_chars > 0) FROM documents) THEN 'ready' ELSE 'held' END
           AS open_status,
         CASE WHEN (SELECT bool_and(lang = 'en') FROM documents) THEN 'ready' ELSE 'held' END
           AS shut_status
  FROM documents""")
def global_gate(spark, sf_dir):
    """All or nothing, once with every row passing and once with some failing."""
    docs = table(spark, sf_dir, "documents")
    both = docs.transform(gate, F.col("n_chars") > 0, "open_gate").transform(
        gate, F.col("lang") == "en", "shut_gate"
    )
    return both.select(
        "doc_id",
        F.when(F.col("open_gate"), "ready").otherwise("held").alias("open_status"),
        F.when(F.col("shut_gate"), "ready").otherwise("held").alias("shut_status"),
    )


@query("""
  SELECT count(*) FILTER (quality IS NULL) AS missing_cases,
         min_by(doc_id, doc_id) FILTER (quality IS NULL) AS first_id
  FROM documents LEFT JOIN labels USING (doc_id)""")
def ground_truth_gate(spark, sf_dir):
    """Documents without a label, and the first of them."""
    cases = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"),
                F.struct("quality", "toxic").alias("ground_truth"))
    )
    return truth_gate(cases)


# ---------------------------------------------------------------- images
@query("""
  SELECT p_partkey,
         CASE WHEN floor(p_retailprice) % 40 = 0 THEN 'empty_body'
              WHEN p_brand = 'Brand#3' THEN 'undecodable'
              WHEN p_size * 10 < 200 OR floor(p_retailprice) < 200 THEN 'too_small'
              WHEN p_type = 'PROMO' THEN 'not_an_image' ELSE 'ok' END AS reason
  FROM part""")
def image_acceptance(spark, sf_dir):
    """Checks in their order on sizes taken from the parts."""
    height = F.floor("p_retailprice").cast("int")
    kind = F.when(F.col("p_type") == "PROMO", " Text/HTML; charset=x").when(
        F.col("p_type") == "SMALL", ""
    ).otherwise("IMAGE/png")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        acceptance(
            height % 40,
            F.when(F.col("p_brand") != "Brand#3", F.col("p_size") * 10),
            height,
            media_type(kind),
        ).alias("reason"),
    )


@query("""
  WITH s AS (SELECT p_partkey, p_type, p_size * 100.0 AS w, floor(p_retailprice) * 3.0 AS h FROM part),
  f AS (SELECT *, least(1.0::DOUBLE, 1800.0::DOUBLE / w, 1800.0::DOUBLE / h) AS k,
          CASE p_type WHEN 'PROMO' THEN 'PNG' WHEN 'SMALL' THEN 'BMP' WHEN 'ECONOMY' THEN 'WEBP'
               ELSE 'TIFF' END AS fmt FROM s)
  SELECT p_partkey, CAST(floor(w * k + 0.5::DOUBLE) AS INT) AS width,
         CAST(floor(h * k + 0.5::DOUBLE) AS INT) AS height, fmt IN ('BMP', 'TIFF') AS converted,
         CASE WHEN fmt IN ('BMP', 'TIFF') THEN 'JPEG' ELSE fmt END AS format,
         CASE fmt WHEN 'PNG' THEN 'image/png' WHEN 'WEBP' THEN 'image/webp' ELSE 'image/jpeg' END
           AS mime
  FROM f""")
def target_size(spark, sf_dir):
    """Longest edge bound and format rules on sizes taken from the parts."""
    fmt = (
        F.when(F.col("p_type") == "PROMO", "PNG").when(F.col("p_type") == "SMALL", "BMP")
        .when(F.col("p_type") == "ECONOMY", "WEBP").otherwise("TIFF")
    )
    size = scaled(F.col("p_size") * F.lit(100.0), F.floor("p_retailprice") * F.lit(3.0))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s"), fmt.alias("f")).select(
        "p_partkey",
        "s.width",
        "s.height",
        needs_conversion(F.col("f")).alias("converted"),
        final_format(F.col("f")).alias("format"),
        final_mime(F.col("f")).alias("mime"),
    )


# ---------------------------------------------------------------- evaluation runs
_API_ERROR_SQL = """
  CASE WHEN source = 'src7' THEN 'bad_json: reply body'
       WHEN source = 'src8' THEN 'HTTP 429: busy later'
       WHEN source = 'src4' THEN 'bad_json: not json'
       WHEN source = 'src1' THEN 'bad_reply: not an object' END"""
_ANSWERED = "source NOT IN ('src2', 'src3', 'src6')"
_CATEGORY_HIT = f"({_ANSWERED} AND quality = (n_chars > 600)::INT)"


@query(f"""
  WITH c AS ({CASES_SQL}),
  e AS (SELECT *, coalesce({_API_ERROR_SQL},
          CASE WHEN source = 'src2' THEN 'bad_reply: answer is not an object'
               WHEN source = 'src6' THEN 'bad_reply: specifications is not an object' END) AS err
        FROM c)
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN image_reason = 'ok' THEN 'ok' ELSE 'download_failed' END AS image_status,
         nullif(image_reason, 'ok') AS image_error,
         CASE WHEN image_reason <> 'ok' THEN 'skipped' WHEN err IS NULL THEN 'ok' ELSE 'failed' END
           AS api_status,
         CASE WHEN image_reason = 'ok' THEN err END AS api_error,
         image_reason = 'ok' AND source NOT IN ('src4', 'src7', 'src8') AS has_response,
         CASE WHEN image_reason = 'ok' AND err IS NULL THEN {_CATEGORY_HIT} END AS category_match,
         CASE WHEN image_reason = 'ok' AND err IS NULL THEN source <> 'src3' END AS name_match,
         CASE WHEN image_reason = 'ok' AND err IS NULL
              THEN CASE WHEN source = 'src3' THEN '<not provided>' ELSE lang END END AS ai_language,
         CASE WHEN image_reason = 'ok' AND err IS NULL THEN '<not provided>' END AS ai_origin
  FROM e""")
def isolated_eval(spark, sf_dir):
    """Every labelled document as a case; failures stay with their own row."""
    report = evaluate_isolated(*cases_and_facts(spark, sf_dir))
    spec = F.col("result.specifications")
    return report.select(
        "id",
        F.col("image.validation.status").alias("image_status"),
        F.col("image.validation.error").alias("image_error"),
        "api_status",
        "api_error",
        F.col("ai_response").isNotNull().alias("has_response"),
        F.col("result.category_match").alias("category_match"),
        F.col("result.item_name_match").alias("name_match"),
        F.try_element_at(spec, F.lit("language"))["ai_answer"].cast("string").alias("ai_language"),
        F.try_element_at(spec, F.lit("origin"))["ai_answer"].cast("string").alias("ai_origin"),
    )


_GATED_COLUMNS = """
  CAST(doc_id AS VARCHAR) AS id, lang AS category_group, source AS source_type"""


@query(f"""
  WITH c AS ({CASES_SQL})
  SELECT {_GATED_COLUMNS},
         CASE WHEN image_reason = 'ok' THEN 'ok' ELSE 'preflight_failed' END AS image_status,
         'skipped_global_preflight' AS api_status, NULL::VARCHAR AS api_error,
         NULL::BOOLEAN AS category_match, NULL::VARCHAR AS ai_name
  FROM c""")
def gated_eval(spark, sf_dir):
    """Some images fail, so no case is answered."""
    return _gated_columns(evaluate_gated(*cases_and_facts(spark, sf_dir)))


@query(f"""
  WITH c AS ({CASES_SQL}),
  e AS (SELECT *, {_API_ERROR_SQL} AS err FROM c)
  SELECT {_GATED_COLUMNS}, 'ok' AS image_status,
         CASE WHEN err IS NULL THEN 'ok' ELSE 'failed' END AS api_status, err AS api_error,
         CASE WHEN err IS NULL THEN {_CATEGORY_HIT} END AS category_match,
         CASE WHEN err IS NULL AND {_ANSWERED} THEN lang END AS ai_name
  FROM e""")
def gated_eval_open(spark, sf_dir):
    """Every image passes, so every case is answered and compared."""
    cases, images, replies = cases_and_facts(spark, sf_dir)
    return _gated_columns(evaluate_gated(cases, as_passed(images), replies))


def _gated_columns(report):
    return report.select(
        "id",
        "category_group",
        "source_type",
        F.col("image.validation.status").alias("image_status"),
        "api_status",
        "api_error",
        F.col("result.category_match_strict").alias("category_match"),
        F.col("result.ai_purchase_name").cast("string").alias("ai_name"),
    )


@query(f"""
  WITH c AS ({CASES_SQL}),
  e AS (SELECT *, coalesce({_API_ERROR_SQL},
          CASE WHEN source IN ('src2', 'src6') THEN 'x' END) AS err FROM c)
  SELECT count(*) AS rows, count(*) FILTER (image_reason <> 'ok' OR err IS NOT NULL) AS failures,
         count(*) FILTER (image_reason <> 'ok' OR err IS NOT NULL) = 0 AS passed
  FROM e""")
def run_verdict(spark, sf_dir):
    return folds.run_verdict(evaluate_isolated(*cases_and_facts(spark, sf_dir)))


@query(f"""
  WITH c AS ({CASES_SQL}),
  e AS (SELECT *, coalesce({_API_ERROR_SQL},
          CASE WHEN source IN ('src2', 'src6') THEN 'x' END) AS err FROM c)
  SELECT CASE WHEN image_reason = 'ok' THEN 'ok' ELSE 'download_failed' END AS preflight_status,
         CASE WHEN image_reason <> 'ok' THEN 'skipped' WHEN err IS NULL THEN 'ok' ELSE 'failed' END
           AS api_status, count(*) AS rows
  FROM e GROUP BY ALL""")
def status_summary(spark, sf_dir):
    report = evaluate_isolated(*cases_and_facts(spark, sf_dir))
    return folds.status_summary(
        report.withColumn("preflight_status", F.col("image.validation.status"))
    )


@query(f"""
  WITH c AS ({CASES_SQL}), e AS (SELECT *, {_API_ERROR_SQL} AS err FROM c)
  SELECT lang AS category_group, count(*) AS cases,
         count(*) FILTER (err IS NULL AND {_CATEGORY_HIT}) AS hits,
         count(*) FILTER (err IS NULL AND {_CATEGORY_HIT}) / count(*) AS accuracy
  FROM e GROUP BY lang""")
def accuracy_by_group(spark, sf_dir):
    """Strict category hits per language over the gated run with open gate."""
    cases, images, replies = cases_and_facts(spark, sf_dir)
    report = evaluate_gated(cases, as_passed(images), replies)
    return folds.accuracy_by_group(
        report.withColumn("category_match", F.col("result.category_match_strict")), "category_group"
    )


# ---------------------------------------------------------------- joins and unions
@query("""
  SELECT o_orderkey, max_by(l_partkey, l_linenumber * 1000000000000 + l_partkey) AS part,
         max(l_linenumber) AS line
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def case_join(spark, sf_dir):
    """Each order with its last line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"
    )
    joined = join_facts(
        orders, lines, "last", key="o_orderkey", latest=F.struct("l_linenumber", "l_partkey"),
        spread="o_orderkey",
    )
    return joined.select(
        "o_orderkey", F.col("last.l_partkey").alias("part"), F.col("last.l_linenumber").alias("line")
    )


@query("""
  SELECT c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
         AS prepared
  FROM customer""")
def prepared_split(spark, sf_dir):
    """Customers with and without orders, apart and together again."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    key = "c_custkey"
    ready = prepared_rows(customers, orders, key, key).withColumn("prepared", F.lit(True))
    failed = unprepared_rows(customers, orders, key, key).withColumn("prepared", F.lit(False))
    return merge_failed_and_prepared(failed, ready)


@query("""
  SELECT md5(text) AS id, doc_id AS pos,
         max_by(source, doc_id) OVER (PARTITION BY text) AS source
  FROM documents""")
def last_prepared(spark, sf_dir):
    """Copies of a text share an id; each row carries the source of the last copy."""
    docs = table(spark, sf_dir, "documents").select(
        F.md5("text").alias("id"), F.col("doc_id").alias("pos"), "source"
    )
    return last_of_id(docs)


@query("""
  SELECT 'case' AS origin, CAST(doc_id AS VARCHAR) AS id, quality, NULL::VARCHAR AS text FROM labels
  UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), NULL, text FROM benchmark""")
def unify_sets(spark, sf_dir):
    """Two datasets of different shape in one table."""
    labels = table(spark, sf_dir, "labels").select(
        F.lit("case").alias("origin"), F.col("doc_id").cast("string").alias("id"), "quality"
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.lit("item").alias("origin"), F.col("item_id").cast("string").alias("id"), "text"
    )
    return unify_datasets(labels, items)


@query("""
  SELECT doc_id, image_reason AS reason FROM ({cases}) WHERE image_reason <> 'ok'
  UNION ALL
  SELECT doc_id, NULL FROM ({cases}) WHERE image_reason = 'ok' AND toxic = 1""".format(
    cases=CASES_SQL
))
def failed_only(spark, sf_dir):
    """Rows not ok, a missing status included."""
    cases, images, _ = cases_and_facts(spark, sf_dir)
    toxic = F.try_element_at(F.col("ground_truth.specifications"), F.lit("toxic")) == "1"
    joined = cases.join(images.select("id", "status", "error"), "id").withColumn(
        "api_status", F.when(F.col("status") != "ok", "failed").when(~toxic, "ok")
    )
    return failed_rows(joined).select(
        F.col("id").cast("long").alias("doc_id"), F.col("error").alias("reason")
    )


# ---------------------------------------------------------------- lists
@query("""
  SELECT role, CASE WHEN length(line) > 60 THEN 'observed' WHEN length(line) > 20 THEN 'estimated'
               ELSE 'unconfirmed' END AS evidence_level, count(*) AS items
  FROM (SELECT role, unnest(string_split(text, E'\\n')) AS line FROM conversations) GROUP BY ALL""")
def evidence_profile(spark, sf_dir):
    """Lines of every turn as specification items, their level by length."""
    level = lambda line: (
        F.when(F.length(line) > 60, "observed").when(F.length(line) > 20, "estimated")
        .otherwise("unconfirmed")
    )
    turns = table(spark, sf_dir, "conversations").select(
        "role",
        F.transform(
            F.split("text", "\n"),
            lambda line: F.struct(line.alias("label"), level(line).alias("evidence_level")),
        ).alias("specifications"),
    )
    return folds.evidence_profile(turns, "role")


@query("""
  SELECT conv_id, turn, i - 1 AS index, line AS item,
         array_to_string(string_split(text, E'\\n'), '／') AS names_line
  FROM (SELECT conv_id, turn, text, unnest(string_split(text, E'\\n')) AS line,
               generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM conversations)""")
def explode_features(spark, sf_dir):
    """Lines of every turn with their index, and the turn as one joined line."""
    turns = table(spark, sf_dir, "conversations").withColumn("lines", F.split("text", "\n"))
    turns = turns.withColumn("names_line", join_names(F.col("lines")))
    return explode_items(turns, "lines", "conv_id", "turn", "names_line")
