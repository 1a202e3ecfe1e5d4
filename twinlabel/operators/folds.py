"""Aggregates and latest-value folds.

Every fold is an associative aggregate, so a key that holds a third of all rows
is reduced in the map tasks before anything is shuffled.  No fold runs a window
over the raw rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORIES, MAX_ATTEMPTS, PROVIDER_CODES


# --- counts -----------------------------------------------------------------
def failure_count(status: Column) -> Column:
    """Aggregate: rows whose status is not ``ok``."""
    return F.count_if(~status.eqNullSafe("ok"))


def run_verdict(df: DataFrame, status: str = "api_status") -> DataFrame:
    """One row: number of rows, number of failures, and whether the run passed."""
    failures = failure_count(F.col(status))
    return df.agg(
        F.count("*").alias("rows"), failures.alias("failures"), (failures == 0).alias("passed")
    )


def completed_count(results: DataFrame, key: str = "image_id", provider: str = "provider",
                    providers=PROVIDER_CODES) -> DataFrame:
    """Providers with a result per image, out of the known ones."""
    seen = [
        F.max(F.when(F.col(provider) == p, F.lit(1)).otherwise(F.lit(0))) for p in providers
    ]
    total = seen[0]
    for one in seen[1:]:
        total = total + one
    return results.groupBy(key).agg(
        total.alias("completed"), F.lit(len(providers)).alias("expected")
    )


def accuracy_by_group(results: DataFrame, *keys: str, match: str = "category_match") -> DataFrame:
    """Cases, hits and hit rate per group."""
    hits = F.count_if(F.col(match))
    return results.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        hits.alias("hits"),
        (hits / F.count("*")).alias("accuracy"),
    )


def reroute_matrix(results: DataFrame, *keys: str, routed: str = "routed_category",
                   final: str = "final_category", categories=CATEGORIES) -> DataFrame:
    """Rows per routed category (down) and final category (across); null where none."""
    cells = [
        F.nullif(F.count_if(F.col(final) == c), F.lit(0)).alias(c.replace("-", "_"))
        for c in categories
    ]
    return results.groupBy(*keys, routed).agg(*cells)


def evidence_profile(results: DataFrame, *keys: str, specs: str = "specifications") -> DataFrame:
    """Specification items per evidence level."""
    return (
        results.select(*keys, F.explode(specs).alias("spec"))
        .groupBy(*keys, F.col("spec.evidence_level").alias("evidence_level"))
        .agg(F.count("*").alias("items"))
    )


def status_summary(results: DataFrame, *keys: str, preflight: str = "preflight_status",
                   api: str = "api_status") -> DataFrame:
    return results.groupBy(*keys, preflight, api).agg(F.count("*").alias("rows"))


def distinct_candidates(urls: Column) -> Column:
    """Without repeats, first occurrence kept."""
    return F.array_distinct(urls)


# --- latest values ----------------------------------------------------------
def latest_result(results: DataFrame, keys=("image_id", "provider"), order=("ts", "request_id"),
                  ) -> DataFrame:
    """The newest result per image and provider; ties fall to the greatest id."""
    rest = [c for c in results.columns if c not in keys]
    return (
        results.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def provider_state(events: DataFrame, keys=("image_id", "provider"), order=("ts", "event_id"),
                   kind: str = "kind", result: str = "result", error: str = "error") -> DataFrame:
    """Shown result and error after all ``start``/``ok``/``error`` events of a key.

    A start clears the error, a failure sets it, a result never clears either:
    an older result stays visible beside a newer error.
    """
    at = F.struct(*order)
    is_ok = F.col(kind) == "ok"
    touches_error = F.col(kind).isin("start", "error")
    shown = F.when(F.col(kind) == "error", F.col(error))
    return events.groupBy(*keys).agg(
        F.max_by(F.when(is_ok, F.col(result)), F.when(is_ok, at)).alias("result"),
        F.max_by(shown, F.when(touches_error, at)).alias("error"),
    )


def reset_on_new_image(events: DataFrame, session: str = "session_id", image: str = "image_seq",
                       provider: str = "provider", order=("ts", "event_id"), kind: str = "kind",
                       result: str = "result", error: str = "error") -> DataFrame:
    """State per session and provider for the session's newest image only.

    Folds to one row per (session, image, provider) first; the newest image is
    then the maximum over those few rows, joined back to them.
    """
    folded = provider_state(events, (session, image, provider), order, kind, result, error)
    newest = events.groupBy(session).agg(F.max(image).alias(image))
    return folded.where(F.col(provider).isNotNull()).join(newest, [session, image], "left_semi")


def first_success_attempt(attempts: DataFrame, keys=("id",), attempt: str = "attempt",
                          ok: str = "ok", error: str = "error",
                          limit: int = MAX_ATTEMPTS) -> DataFrame:
    """The first successful of at most ``limit`` attempts per key.

    Without a success the last error is the reason.  ``planned_wait_s`` is what
    the attempts before the outcome waited: 2 s after the first, 4 s after the second.
    """
    used = attempts.where(F.col(attempt) <= limit)
    good = F.coalesce(F.col(ok), F.lit(False))
    folded = used.groupBy(*keys).agg(
        F.min(F.when(good, F.col(attempt))).alias("success_attempt"),
        F.max(attempt).alias("last_attempt"),
        F.max_by(error, F.when(~good, F.col(attempt))).alias("_last_error"),
    )
    done = F.coalesce("success_attempt", "last_attempt")
    return folded.select(
        *keys,
        "success_attempt",
        F.least(done, F.lit(limit)).alias("attempts_made"),
        F.when(F.col("success_attempt").isNull(), F.coalesce("_last_error", F.lit("download failed")))
        .alias("error"),
        (done * (done - 1)).alias("planned_wait_s"),
    )


def number_attempts(log: DataFrame, keys, order, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Number the first ``limit`` tries of each key.

    The rank limit right on top of the window lets every map task drop all but
    ``limit`` rows of a key before the shuffle, so a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("attempt", F.row_number().over(window)).where(F.col("attempt") <= limit)
