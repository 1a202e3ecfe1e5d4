"""Report shaping: projection, order, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .lookups import provider_ordinal


def numbered(report: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """``report`` with its place in ``order``, counted from 0 over all rows.

    A range sort gives every task a stretch of the order; a row's number is its place in the
    stretch and the count of all stretches before it, one row per task.  The sorted rows are
    written, so the numbers hold; rows that agree in ``order`` are numbered as they came.
    """
    spark = report.sparkSession
    path = f"{scratch_dir(spark, 'numbered')}/rows"
    (
        report.withColumn("_came", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_came")
        .sortWithinPartitions(*order, "_came")
        .drop("_came")
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    counts = rows.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    offsets = counts.select("_task", shift.alias("_shift"))
    return (
        rows.join(F.broadcast(offsets), "_task")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_task", "_at", "_shift")
    )


def order_by_id(report: DataFrame) -> DataFrame:
    return report.orderBy("id")


def dataset_order(report: DataFrame) -> DataFrame:
    return report.orderBy("pos")


def provider_order(results: DataFrame, *keys: str) -> DataFrame:
    """Fixed display order of providers within the given keys."""
    return results.orderBy(*keys, provider_ordinal(F.col("provider")))


def case_projection_isolated(cases: DataFrame) -> DataFrame:
    return cases.select(
        "pos", "id", F.struct(F.col("image_url").alias("url"), "source_page").alias("image"),
        "ground_truth",
    )


def case_projection_gated(cases: DataFrame) -> DataFrame:
    return cases.select(
        "pos", "id", "category_group", "source_page", "source_type", "ground_truth"
    )


def image_source(image_url: Column, resolved: Column) -> Column:
    """The explicit link when there is one, else the resolved link."""
    return F.coalesce(F.nullif(image_url, F.lit("")), resolved)


def envelope(provider: Column, model: Column, routing: Column, result: Column) -> Column:
    return F.struct(
        provider.alias("provider"), model.alias("model"), routing.alias("routing"),
        result.alias("result"),
    )


def merge_failed_and_prepared(failed: DataFrame, prepared: DataFrame) -> DataFrame:
    """Both sets of rows in one report; a bag, nothing is de-duplicated."""
    return failed.unionByName(prepared, allowMissingColumns=True)


def unify_datasets(*datasets: DataFrame) -> DataFrame:
    """One table from datasets of different shape; fields one lacks are null."""
    out = datasets[0]
    for other in datasets[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
