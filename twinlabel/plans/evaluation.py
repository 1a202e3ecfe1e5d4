"""Evaluation of landed replies against ground truth.

``evaluate_isolated``: a case that fails its image check is skipped, the others
go on.  ``evaluate_gated``: one failed image check holds back every case.
Errors are columns; no row is ever lost to an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import ABSENT_SPEC
from ..functions.nested import spec_or_empty, spec_side_by_side
from ..functions.replies import (
    all_output_text,
    answer_or_empty,
    content_items,
    field,
    is_object,
    parse_json,
    python_text,
)
from ..functions.text import (
    category_match,
    strip_code_fence,
    token_overlap_match,
    token_set,
    upstream_error,
)
from ..operators.folds import failure_count
from ..operators.gates import BASIC_POLICY, STRICT_POLICY, require_gates
from ..operators.joins import all_ok, hot_key_join, last_of_each
from ..operators.reports import case_projection_gated, case_projection_isolated, numbered
from ..session import scratch_dir
from ..sources.writers import write_eval_report

NOTE_ISOLATED = "Specification values stand side by side for review; nothing judges their meaning."
NOTE_GATED = (
    "Names and specifications are not judged. The strict category flag is for information:"
    " some parts belong to more than one category."
)


def read_reply(replies: DataFrame, *carried: str) -> DataFrame:
    """Landed bodies to ``ai_response`` (VARIANT) or ``api_error``, one row per reply."""
    return (
        replies.select("id", "http_status", "body", *carried)
        .withColumn("_body", parse_json(F.col("body")))
        .withColumn("_items", content_items(F.col("_body")))
        .withColumn("_joined", all_output_text(F.col("_body"), F.col("_items")))
        .withColumn("_text", strip_code_fence(F.col("_joined")))
        .withColumn("_value", parse_json(F.col("_text")))
        .select(
            "id",
            *carried,
            F.when(F.col("_body").isNull(), F.lit("bad_json: reply body"))
            .when(
                ~F.col("http_status").between(200, 299),
                upstream_error(
                    F.col("http_status"),
                    field(F.col("_body"), "$.error.code", "string"),
                    field(F.col("_body"), "$.error.message", "string"),
                ),
            )
            .when(F.col("_text").isNull(), F.lit("bad_shape: reply body"))
            .when(F.col("_text") == "", F.lit("empty_reply: no text"))
            .when(
                F.col("_value").isNull(),
                F.concat(F.lit("bad_json: "), F.col("_text")),
            )
            .alias("api_error"),
            F.when(F.col("http_status").between(200, 299), F.col("_value")).alias("ai_response"),
        )
    )


def _given(answer: Column, name: str) -> Column:
    return F.try_element_at(answer, F.lit(name))


def compare_isolated(df: DataFrame, gt: str = "ground_truth", response: str = "ai_response",
                     ) -> DataFrame:
    """Add ``result`` and ``compare_error``, which is null when the comparison works."""
    df = df.withColumn("_answer", answer_or_empty(F.col(response), null_is_empty=False))
    answer, truth = F.col("_answer"), F.col(gt)
    df = df.withColumns(
        {
            "_category": python_text(_given(answer, "category")),
            "_name": token_set(python_text(_given(answer, "item_name"))),
            "_truth_name": token_set(truth["item_name"]),
            "_specs": field(_given(answer, "specifications"), "$", "map<string,variant>"),
            "_specs_text": python_text(_given(answer, "specifications")),
        }
    )
    expected = spec_or_empty(truth["specifications"])
    # Specifications that are not an object fail only when a field is looked up in them.
    unusable = (F.size(expected) > 0) & F.col("_specs").isNull() & (F.col("_specs_text") != "")
    error = (
        F.when(~is_object(F.col(response)), "bad_reply: not an object")
        .when(answer.isNull(), "bad_reply: answer is not an object")
        .when(truth["category"].isNull(), "ground_truth: no category")
        .when(truth["item_name"].isNull(), "ground_truth: no item_name")
        .when(unusable, "bad_reply: specifications is not an object")
    )
    given = F.coalesce("_specs", F.create_map().cast("map<string,variant>"))
    absent = F.parse_json(F.lit(f'"{ABSENT_SPEC}"'))
    result = F.struct(
        category_match(truth["category"], F.col("_category")).alias("category_match"),
        token_overlap_match(F.col("_truth_name"), F.col("_name")).alias("item_name_match"),
        spec_side_by_side(expected, given, absent).alias("specifications"),
        F.lit(NOTE_ISOLATED).alias("note"),
    )
    return df.withColumns({"result": result, "compare_error": error}).drop(
        "_answer", "_category", "_name", "_truth_name", "_specs", "_specs_text"
    )


def compare_gated(df: DataFrame, gt: str = "ground_truth", response: str = "ai_response",
                  ) -> DataFrame:
    """Like ``compare_isolated``; values are carried side by side without a name verdict."""
    df = df.withColumn("_answer", answer_or_empty(F.col(response), null_is_empty=True))
    answer, truth = F.col("_answer"), F.col(gt)
    error = (
        F.when(~is_object(F.col(response)), "bad_reply: not an object")
        .when(answer.isNull(), "bad_reply: answer is not an object")
        .when(truth["category"].isNull(), "ground_truth: no category")
        .when(truth["taiwan_purchase_name"].isNull(), "ground_truth: no purchase name")
    )
    result = F.struct(
        category_match(truth["category"], python_text(_given(answer, "category")))
        .alias("category_match_strict"),
        truth["taiwan_purchase_name"].alias("ground_truth_purchase_name"),
        F.coalesce(truth["accepted_names_zh_tw"], F.array().cast("array<string>"))
        .alias("accepted_ground_truth_names"),
        _given(answer, "item_name_zh_tw").alias("ai_purchase_name"),
        spec_or_empty(truth["specifications"]).alias("ground_truth_specifications"),
        F.coalesce(_given(answer, "specifications"), F.parse_json(F.lit("{}")))
        .alias("ai_specifications"),
        _given(answer, "purchase_phrase_zh_tw").alias("ai_purchase_phrase"),
        F.coalesce(_given(answer, "missing_purchase_info"), F.parse_json(F.lit("[]")))
        .alias("ai_missing_purchase_info"),
        F.lit(NOTE_GATED).alias("note"),
    )
    return df.withColumns({"result": result, "compare_error": error}).drop("_answer")


def _checked(images: DataFrame, latest: str | None) -> DataFrame:
    """Image observations reduced to one row per id."""
    rest = [c for c in images.columns if c not in ("id", latest)]
    spelled = F.struct(F.col("status") == "ok", F.to_json(F.struct(*rest)))
    order = F.struct(latest, spelled) if latest else spelled
    return images.groupBy("id").agg(
        F.max_by(F.struct(*rest), order).alias("validation"), F.count("*").alias("_images")
    )


def _validation(column: Column, failed_status: str, fields: list[str]) -> Column:
    """Image struct with the run's own failure word; an image never landed has failed."""
    ok = F.coalesce(column["status"] == "ok", F.lit(False))
    parts = [F.when(ok, F.lit("ok")).otherwise(F.lit(failed_status)).alias("status")]
    parts += [F.when(ok, column[f]).alias(f) for f in fields if f not in ("status", "error")]
    parts.append(
        F.when(~ok, F.coalesce(column["error"], F.lit("download failed"))).alias("error")
    )
    return F.struct(*parts)


def _with_result(df: DataFrame, open_gate: Column, skipped: str, compare) -> DataFrame:
    """Add api_status, ai_response, result and api_error.

    ``ai_response`` stays when the comparison after a good reply fails.
    """
    compared = (
        df.withColumn("_open", open_gate)
        .withColumn("ai_response", F.when(F.col("_open"), F.col("_reply.ai_response")))
        .transform(compare)
    )
    error = F.when(F.col("_reply").isNull(), F.lit("no_reply: none landed")).otherwise(
        F.coalesce("_reply.api_error", "compare_error")
    )
    return (
        compared.withColumn("api_error", F.when(F.col("_open"), error))
        .withColumn(
            "api_status",
            F.when(~F.col("_open"), skipped).when(F.col("api_error").isNull(), "ok")
            .otherwise("failed"),
        )
        .withColumn("result", F.when(F.col("api_status") == "ok", F.col("result")))
        .drop("_reply", "_open", "compare_error")
    )


def _facts(images: DataFrame, replies: DataFrame, latest: str | None,
           quality: Observation | None) -> DataFrame:
    """``validation`` and ``_reply`` side by side, one row per id.

    Of several rows with one id the greatest ``latest`` counts; without such a column, and
    between equal ones, a good one is taken before a bad one and else the greatest text.
    ``quality`` learns how many ids had several, from the same pass.
    """
    spelled = F.struct(
        F.col("api_error").isNull(), F.coalesce("api_error", F.lit("")), F.to_json("ai_response")
    )
    if latest:
        # The last body is chosen before any is parsed.
        replies = replies.groupBy("id").agg(
            F.max_by(
                F.struct("http_status", "body"), F.struct(latest, "http_status", "body")
            ).alias("_last"),
            F.count("*").alias("_rows"),
        ).select("id", "_last.*", "_rows")
    else:
        replies = replies.withColumn("_rows", F.lit(1))
    answered = read_reply(replies, "_rows").groupBy("id").agg(
        F.max_by(F.struct("api_error", "ai_response"), spelled).alias("_reply"),
        F.sum("_rows").alias("_replies"),
    )
    facts = _checked(images, latest).join(answered, "id", "full")
    if quality is not None:
        facts = facts.observe(
            quality,
            F.count_if(F.col("_images") > 1).alias("repeated_images"),
            F.count_if(F.col("_replies") > 1).alias("repeated_replies"),
        )
    return facts.drop("_images", "_replies")


def evaluate_isolated(cases: DataFrame, images: DataFrame, replies: DataFrame,
                      latest: str | None = None, quality: Observation | None = None) -> DataFrame:
    """Per-case isolation.  ``images``: id, status, error and observations;
    ``replies``: id, http_status, body.  ``latest`` names a column of both that tells which of
    several rows with one id is the last; ``quality`` is told how many ids had several once the
    report is computed.  Order the report with ``dataset_order``."""
    fields = [c for c in images.columns if c not in ("id", latest)]
    facts = _facts(images, replies, latest, quality)
    joined = hot_key_join(case_projection_isolated(cases), facts, "id", "pos")
    checked = joined.withColumn(
        "image",
        F.col("image").withField(
            "validation", _validation(F.col("validation"), "download_failed", fields)
        ),
    ).drop("validation")
    passed = F.col("image.validation.status") == "ok"
    return _with_result(checked, passed, "skipped", compare_isolated)


def evaluate_gated(cases: DataFrame, images: DataFrame, replies: DataFrame,
                   latest: str | None = None, quality: Observation | None = None) -> DataFrame:
    """All or nothing.  ``images`` additionally holds ``resolved_url``.

    Of several cases with one id each row carries the last one's content; ``latest`` and
    ``quality`` are as in ``evaluate_isolated``.  No reply is parsed while the gate is shut.  Order the report with
    ``order_by_id``.
    """
    fields = [c for c in images.columns if c not in ("id", "resolved_url", latest)]
    passed = images.groupBy("id").agg(F.bool_or(F.col("status") == "ok").alias("ok"))
    # One failed or missing image is enough; ids are compared once each.
    ids = cases.select("id").distinct().join(passed, "id", "left")
    # The gate is settled first: a shut one leaves the replies unread.
    gate = all_ok(ids, F.col("ok"))
    facts = _facts(images, replies if gate else replies.limit(0), latest, quality)
    per_id = last_of_each(case_projection_gated(cases)).join(facts, "id", "left")
    joined = hot_key_join(cases.select("id", "pos"), per_id, "id", "pos")
    ok = F.coalesce(F.col("validation.status") == "ok", F.lit(False))
    checked = joined.withColumn(
        "image",
        F.struct(
            F.when(ok, F.col("validation.resolved_url")).alias("resolved_url"),
            _validation(F.col("validation"), "preflight_failed", fields).alias("validation"),
        ),
    ).drop("validation").withColumn("gate_open", F.lit(gate))
    return _with_result(
        checked, F.col("gate_open"), "skipped_global_preflight", compare_gated
    ).drop("gate_open")


def report_header(header: DataFrame, report: DataFrame, model: str, gated: bool) -> DataFrame:
    """One row: dataset version, model, preflight verdict (gated runs) and failures.

    Reads only the statuses of the report, once; give it the written report.
    """
    status = F.col("api_status")
    held = F.coalesce(F.bool_or(status == "skipped_global_preflight"), F.lit(False))
    counts = report.agg(F.struct(failure_count(status).alias("failures"), held.alias("held")))
    verdict = F.col("_verdict")
    preflight = F.when(verdict["held"], "failed_no_api_calls_made").otherwise("passed_all_images")
    return header.withColumn("_verdict", counts.scalar()).select(
        F.col("version").alias("dataset_version"),
        F.lit(model).alias("model"),
        F.lit(False).alias("generated_images_used"),
        (preflight if gated else F.lit(None).cast("string")).alias("preflight"),
        verdict["failures"].alias("failures"),
        (verdict["failures"] == 0).alias("passed"),
    )


def evaluation_run(header: DataFrame, cases: DataFrame, images: DataFrame, replies: DataFrame,
                   path: str, model: str, gated: bool, latest: str | None = None,
                   fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """One evaluation, start to end: gates, comparison, ordered report, verdict.

    Stops with an error before anything is compared if the dataset's policy does not hold or a
    case lacks ground truth; the gated run asks for one flag more.  The report is written below
    ``path`` in the order of ids (gated) or of the dataset, with its ``row``.  Returns the report
    and its header as written; the header also counts the ids with repeated images or replies.
    """
    require_gates(header, cases, STRICT_POLICY if gated else BASIC_POLICY)
    spark, quality = cases.sparkSession, Observation()
    evaluate = evaluate_gated if gated else evaluate_isolated
    # Computed once; the sort then samples a table.
    report = evaluate(cases, images, replies, latest, quality)
    computed = f"{scratch_dir(spark, 'evaluation')}/report"
    report.write.parquet(computed)
    found = {name: F.lit(count).alias(name) for name, count in quality.get.items()}
    ordered = numbered(
        spark.read.schema(report.schema).parquet(computed), *(["id", "pos"] if gated else ["pos"])
    )

    def head(rows: DataFrame) -> DataFrame:
        return report_header(header, rows, model, gated).select("*", *found.values())

    write_eval_report(ordered, head, path, fmt)
    return tuple(
        spark.read.format(fmt).schema(kind).load(f"{path}/{name}")
        for name, kind in (("cases", ordered.schema), ("header", head(ordered).schema))
    )
