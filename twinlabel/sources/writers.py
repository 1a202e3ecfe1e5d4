"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LOG_TEXT_CHARS
from ..functions.text import truncate_text


def write_eval_report(report: DataFrame, make_header: Callable[[DataFrame], DataFrame], path: str,
                      fmt: str = "parquet") -> None:
    """Case rows and a header row side by side below ``path``.

    The cases are written first and ``make_header`` is given them as written, so
    the evaluation runs once.  JSON keeps non-ASCII as it is.
    """
    spark = report.sparkSession

    def write(df: DataFrame, name: str) -> None:
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "json":
            writer = writer.option("encoding", "UTF-8").option("ignoreNullFields", "false")
        writer.save(f"{path}/{name}")

    write(report, "cases")
    written = spark.read.schema(report.schema).format(fmt).load(f"{path}/cases")
    write(make_header(written), "header")


def log_rows(results: DataFrame, payload: str = "payload") -> DataFrame:
    """``result_text`` cut to its limit, beside the whole payload (cut JSON does not parse)."""
    return results.where(F.col(payload).isNotNull()).select(
        truncate_text(F.col(payload), LOG_TEXT_CHARS).alias("result_text"),
        F.col(payload).alias("full_text"),
    )


def append_result_log(results: DataFrame, path: str | None, payload: str = "payload") -> None:
    """Append one log row per result; without a sink nothing is written."""
    if path:
        log_rows(results, payload).write.mode("append").parquet(path)
