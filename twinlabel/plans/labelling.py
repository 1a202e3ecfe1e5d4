"""Two-stage labelling.

A record is routed to a category by a first model call, gets the reference text
of that category, and is described by a second call.  Replies of each stage are
written to a table keyed by what was sent, so neither a retried task of a later
job nor a rerun pays for a finished call again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import OUTPUT_BUDGET, PROVIDERS
from ..functions.encoding import sha256, valid_payload
from ..functions.prompts import (
    JSON_SCHEMAS,
    SCHEMA_NAMES,
    TEMPLATES,
    call_key,
    render_prompt,
    request_body,
    result_payload,
)
from ..functions.replies import field, json_pair, parse_status, whole_json
from ..operators.gates import request_status
from ..operators.guards import guard_identification, guard_routing
from ..operators.lookups import (
    Providers,
    attach_category_pack,
    attach_core_pack,
    provider_model,
)
from ..operators.nested import pin
from ..operators.reports import envelope
from ..schemas import IDENTIFICATION, STORED_REPLY
from ..session import path_exists
from ..sources.payloads import PayloadStore
from ..sources.reply_log import BATCH_CALLS, append_replies
from ..sources.writers import append_result_log

# A client takes one request (provider, model, prompt, image, mime, schema_name,
# schema, max_output_tokens) and returns the reply text; with a method ``many`` it takes a
# list of them.  A factory makes one client per provider and task.
Client = Callable[[dict], str]
ClientFactory = Callable[[], Client]

_CALL_COLUMNS = ("call_key", "provider", "model", "prompt", "image", "mime")


def speculates(spark: SparkSession) -> bool:
    """Whether Spark may run a second copy of a slow task, and so repeat its calls."""
    return spark.conf.get("spark.speculation", "false") == "true"


def _run_folder(work: str) -> str:
    """A folder of this run's own: what an earlier run returned stays readable."""
    return f"{work}/run-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage with a table in the shared work folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_replies(stored: DataFrame) -> DataFrame:
    """Stored replies, one per key: a success is preferred to a failure."""
    return stored.groupBy("call_key").agg(
        F.max("reply_text").alias("reply_text"), F.max("error").alias("error")
    )


def answer_calls(calls: DataFrame, store: PayloadStore, factories: Mapping[str, ClientFactory],
                 stage: int, path: str, settled: str, batch_calls: int = BATCH_CALLS) -> DataFrame:
    """Make the calls ``path`` has no success for, append them, return all replies.

    ``calls``: place, call_key, provider, model, prompt, mime.  Equal calls are made once, with
    the payload of the first place that asks for them.  Which rows to send is settled on narrow
    rows; payloads stay in the buckets of the store, a task each.
    """
    spark = calls.sparkSession
    pending = calls.select("call_key", "place")
    # The files of runs before this one; what this run adds comes from its own tasks.
    earlier = None
    if path_exists(spark, path):
        earlier = spark.read.schema(STORED_REPLY).parquet(path)
        done = earlier.where("reply_text is not null")
        pending = pending.join(done.select("call_key"), "call_key", "left_anti")
    chosen = pending.groupBy("call_key").agg(F.min("place").alias("place"))
    narrow = calls.join(chosen, ["call_key", "place"], "left_semi")
    to_send = store.beside(narrow, "image").select(*_CALL_COLUMNS)
    fixed = {
        "schema_name": SCHEMA_NAMES[stage],
        "schema": JSON_SCHEMAS[stage],
        "max_output_tokens": OUTPUT_BUDGET[stage],
    }
    stored = append_replies(to_send, factories, fixed, path, batch_calls, f"{settled}-answered")
    replies = settled_replies(stored if earlier is None else stored.unionByName(earlier))
    # As a table of its own the replies are shuffled by their reader's join, which
    # is what lets AQE split a key shared by very many requests.
    return _written(replies, settled)


def prepare_requests(requests: DataFrame, configured: Iterable[str],
                     providers: Providers = PROVIDERS) -> DataFrame:
    """Payload check, provider lookup and the hash that stands for the payload."""
    image = F.coalesce(F.col("image"), F.lit(""))
    body_ok = F.col("body_ok") if "body_ok" in requests.columns else F.lit(True)
    return requests.withColumns(
        {
            "body_ok": F.coalesce(body_ok, F.lit(True)),
            "model": provider_model(F.col("provider"), providers),
            "payload_ok": valid_payload(image),
            "provider_ready": F.coalesce(
                F.col("provider").isin(*configured)
                & provider_model(F.col("provider"), providers).isNotNull(),
                F.lit(False),
            ),
            "image_hash": sha256(image),
        }
    )


def with_call(requests: DataFrame, stage: int, prompt: Column, budget: int | None = None) -> DataFrame:
    return requests.withColumn("prompt", prompt).withColumn(
        "call_key",
        call_key(F.col("image_hash"), F.col("provider"), F.col("model"), stage, F.col("prompt"),
                 F.col("mime"), budget),
    )


def build_model_requests(requests: DataFrame, stage: int, prompt: Column,
                         budget: int | None = None, providers: Providers = PROVIDERS) -> DataFrame:
    """One row per request with its body as JSON and its key, for an offline batch job."""
    prepared = requests.withColumns(
        {
            "model": provider_model(F.col("provider"), providers),
            "image_hash": sha256(F.coalesce(F.col("image"), F.lit(""))),
        }
    )
    return with_call(prepared, stage, prompt, budget).select(
        "request_id", "provider", "model", "call_key",
        request_body(F.col("provider"), F.col("model"), F.col("image"), F.col("prompt"), stage,
                     F.col("mime"), budget).alias("body"),
    )


def _parsed(replied: DataFrame, guard: Callable[[Column], Column], prefix: str) -> DataFrame:
    """Parse the reply and say why it is not usable, if it is not.

    What is parsed and what is judged of it are pinned: a filter on what follows from them would
    parse the text anew for each of its terms.
    """
    value = whole_json(F.col("_pair"), F.col("reply_text"))
    status = (
        F.when(F.col("reply_text").isNull() & F.col("error").isNotNull(), F.lit("call_failed"))
        .otherwise(parse_status(F.col("reply_text"), F.col(f"{prefix}_value")))
    )
    usable = (
        F.when(F.col("_parse") != "ok", F.col("_parse"))
        .when(~guard(F.col(f"{prefix}_value")), F.lit("incomplete_reply"))
        .otherwise(F.lit("ok"))
    )
    return (
        replied.transform(pin, _pair=json_pair(F.col("reply_text")))
        .transform(pin, **{f"{prefix}_value": value})
        .transform(pin, _parse=status)
        .transform(pin, **{f"{prefix}_status": usable})
        .withColumn(f"{prefix}_error", F.when(F.col(f"{prefix}_status") == "call_failed",
                                              F.col("error")))
        .drop("_pair", "_parse", "reply_text", "error")
    )


def label_two_stage(requests: DataFrame, packs: DataFrame, core: DataFrame,
                    factories: Mapping[str, ClientFactory], work: str,
                    max_clients: int | None = None, templates: Mapping[int, str] = TEMPLATES,
                    batch_calls: int = BATCH_CALLS, providers: Providers = PROVIDERS) -> DataFrame:
    """Label every request; one result row per request row.

    ``requests``: request_id (unique), image_id, provider, image, mime, ts.
    ``packs``: category, text.  ``core``: one row, text.  ``factories``:
    provider -> client factory; a provider without one, or not among ``providers`` (code,
    model, label, note), is not configured.
    ``work``: folder for the reply tables and, in a folder per run, the tables
    between the steps; calls that succeeded in an earlier run over the same
    folder are not made again.

    A row failing at one step never enters the next.  Payloads are checked, hashed and put into
    the buckets of a store in one pass, as many as there may be clients; the stages' calls read
    them there, and all other steps run on narrow written tables.  Replies are committed after
    every ``batch_calls`` calls of a task.  Spark must not run slow tasks twice.
    """
    spark = requests.sparkSession
    if speculates(spark):
        raise ValueError("turn spark.speculation off: it makes slow model calls twice")
    run = _run_folder(work)
    buckets = max_clients or int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts_columns = [
        "request_id", "image_id", "provider", "model", "ts", "mime", "image_hash", "body_ok",
        "payload_ok", "provider_ready",
    ]
    store = PayloadStore(
        prepare_requests(requests, factories, providers).select(*facts_columns, "image"),
        f"{run}/payloads", buckets,
    )
    facts = _written(store.rows().select("place", *facts_columns), f"{run}/requests")
    is_ready = F.col("body_ok") & F.col("payload_ok") & F.col("provider_ready")

    first = with_call(facts.where(is_ready), 1, render_prompt(templates[1]))
    replies_1 = answer_calls(
        first, store, factories, 1, f"{work}/stage=1", f"{run}/replies_1", batch_calls
    )
    routed = _written(
        first.drop("prompt")
        .join(replies_1, "call_key", "left")
        .transform(_parsed, guard_routing, "routing")
        .withColumns(
            {
                "category": field(F.col("routing_value"), "$.category", "string"),
                "reason": field(F.col("routing_value"), "$.reason", "string"),
            }
        )
        .drop("call_key", "routing_value"),
        f"{run}/routed",
    )

    referenced = (
        routed.where("routing_status = 'ok'")
        .transform(attach_category_pack, packs)
        .transform(attach_core_pack, core)
    )
    has_reference = F.col("pack").isNotNull() & F.col("core").isNotNull()
    second = with_call(
        referenced.where(has_reference),
        2,
        render_prompt(templates[2], category=F.col("category"), reason=F.col("reason"),
                      core=F.col("core"), pack=F.col("pack")),
    ).drop("pack", "core")
    replies_2 = answer_calls(
        second, store, factories, 2, f"{work}/stage=2", f"{run}/replies_2", batch_calls
    )
    store.drop()
    described = (
        second.drop("prompt")
        .join(replies_2, "call_key", "left")
        .transform(_parsed, guard_identification, "identification")
        .drop("call_key")
    )

    everything = (
        described.unionByName(facts.where(~is_ready), allowMissingColumns=True)
        .unionByName(routed.where("routing_status <> 'ok'"), allowMissingColumns=True)
        .unionByName(
            referenced.where(~has_reference).drop("pack", "core"), allowMissingColumns=True
        )
    )
    ok = F.col("status") == 200
    value = F.col("identification_value")
    routing = F.struct("category", "reason")
    return everything.withColumn(
        "status",
        request_status(
            F.col("payload_ok"), F.col("provider_ready"),
            routing_ok=F.col("routing_status") == "ok",
            identification_ok=F.col("identification_status") == "ok",
            body_ok=F.col("body_ok"),
        ),
    ).select(
        "request_id", "image_id", "provider", "model", "ts",
        "status",
        F.when(~F.col("body_ok"), "unreadable_body")
        .when(F.col("status") == 400, "bad_payload")
        .when(F.col("status") == 503, "provider_not_configured")
        .when(F.col("routing_status") != "ok",
              F.concat_ws(": ", F.lit("routing"), "routing_status", "routing_error"))
        .when(F.col("identification_status").isNull(), "reference text missing")
        .when(F.col("identification_status") != "ok",
              F.concat_ws(": ", F.lit("identification"), "identification_status",
                          "identification_error"))
        .alias("error"),
        F.col("category").alias("routed_category"),
        F.when(ok, field(value, "$.category", "string")).alias("final_category"),
        F.when(
            ok,
            envelope(F.col("provider"), F.col("model"), routing,
                     F.try_variant_get(value, "$", IDENTIFICATION)),
        ).alias("response"),
        F.when(ok, result_payload(F.col("provider"), F.col("model"), F.col("category"), value))
        .alias("payload"),
    )


def label_and_log(requests: DataFrame, packs: DataFrame, core: DataFrame,
                  factories: Mapping[str, ClientFactory], work: str, log: str | None = None,
                  max_clients: int | None = None) -> DataFrame:
    """``label_two_stage`` with its results written below ``work`` and logged.

    Without a log path nothing is logged.
    """
    labelled = label_two_stage(requests, packs, core, factories, work, max_clients)
    results = _written(labelled, f"{_run_folder(work)}/results")
    append_result_log(results, log)
    return results
