"""Checks that stop a run or settle a request before any model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY_RULES = {
    "generated_images_allowed": False,
    "ground_truth_required": True,
    "ground_truth_established_before_inference": True,
}
BASIC_POLICY = ("generated_images_allowed", "ground_truth_required")
STRICT_POLICY = tuple(POLICY_RULES)


def policy_violations(policy: Column, flags=STRICT_POLICY) -> Column:
    """Names of the policy flags that do not hold exactly; missing or null does not hold."""
    return F.array_compact(
        F.array(
            *[
                F.when(~policy[name].eqNullSafe(F.lit(POLICY_RULES[name])), F.lit(name))
                for name in flags
            ]
        )
    )


def policy_gate(header: DataFrame, flags=STRICT_POLICY) -> DataFrame:
    """The dataset header with its ``violations``."""
    return header.withColumn("violations", policy_violations(F.col("policy"), flags))


def ground_truth_missing(df: DataFrame, column: str = "ground_truth") -> Column:
    """Null, or a struct without a single value (a typed struct cannot tell ``{}`` apart)."""
    fields = df.schema[column].dataType.fieldNames()
    missing = F.col(column).isNull()
    all_null = F.lit(True)
    for name in fields:
        all_null = all_null & F.col(f"{column}.{name}").isNull()
    return missing | all_null


def ground_truth_gate(cases: DataFrame, order: str = "pos") -> DataFrame:
    """One row: how many cases lack ground truth, and the first of them in file order."""
    missing = ground_truth_missing(cases)
    return cases.agg(
        F.count_if(missing).alias("missing_cases"),
        F.min_by(F.when(missing, F.col("id")), F.when(missing, F.col(order))).alias("first_id"),
    )


def require_gates(header: DataFrame, cases: DataFrame, flags=STRICT_POLICY) -> None:
    """Raise unless the policy holds and every case has ground truth.

    Brings one header row and one aggregate row to the driver.
    """
    for row in policy_gate(header, flags).select("violations").take(1):
        if row.violations:
            raise ValueError(f"dataset policy does not hold: {', '.join(row.violations)}")
    verdict = ground_truth_gate(cases).first()
    if verdict.missing_cases:
        raise ValueError(f"{verdict.first_id} has no ground truth")


def request_status(
    payload_ok: Column,
    provider_ready: Column,
    routing_ok: Column | None = None,
    pack_ok: Column | None = None,
    identification_ok: Column | None = None,
    body_ok: Column | None = None,
) -> Column:
    """HTTP-like status, first failure wins.

    502 for an unreadable body, 400 for a bad payload, 503 for a provider not
    configured, 502 for any later stage, else 200.
    """
    readable = F.lit(True) if body_ok is None else F.coalesce(body_ok, F.lit(True))
    status = (
        F.when(~readable, F.lit(502))
        .when(~F.coalesce(payload_ok, F.lit(False)), F.lit(400))
        .when(~F.coalesce(provider_ready, F.lit(False)), F.lit(503))
    )
    for stage in (routing_ok, pack_ok, identification_ok):
        if stage is not None:
            status = status.when(~F.coalesce(stage, F.lit(False)), F.lit(502))
    return status.otherwise(F.lit(200))


def failed_rows(df: DataFrame, status: str = "api_status") -> DataFrame:
    """Rows whose status is anything but ``ok``; a missing status counts as failed."""
    return df.where(~F.col(status).eqNullSafe("ok"))
