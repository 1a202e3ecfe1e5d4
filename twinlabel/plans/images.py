"""Preflight of landed image files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_EDGE_PX
from ..functions.images import (
    acceptance_detail,
    file_format,
    final_format,
    final_mime,
    image_acceptance,
    needs_conversion,
)
from ..functions.text import media_type


def image_preflight(files: DataFrame, manifest: DataFrame | None = None,
                    min_edge: int = MIN_EDGE_PX) -> DataFrame:
    """Accept or reject each file and describe it.

    ``files`` comes from ``read_image_files``; ``manifest`` (path, content_type and
    any further columns, such as the id an evaluation joins on)
    adds the declared types and the files that hold no bytes, which Spark's file
    sources leave out.  A file to be converted keeps null final bytes and
    hash: transcoding is left to the caller.
    """
    if manifest is None:
        typed = files.withColumn("content_type", F.lit(None).cast("string"))
    else:
        typed = files.join(manifest, "path", "full")
    typed = typed.withColumn("content_type", media_type(F.col("content_type")))
    reason = image_acceptance(
        F.col("length"), F.col("width"), F.col("height"), F.col("content_type"), min_edge
    )
    fmt = F.col("original_format")
    convert = needs_conversion(fmt)
    return (
        typed.withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason") == "ok", "ok").otherwise("download_failed"))
        .withColumn(
            "error",
            F.when(
                F.col("reason") != "ok",
                F.concat_ws(": ", "reason", acceptance_detail(
                    F.col("reason"), F.col("width"), F.col("height"), F.col("content_type"))),
            ),
        )
        .withColumns(
            {
                "converted_for_api": convert,
                "format": final_format(fmt),
                "mime": final_mime(fmt),
                "api_bytes": F.when(~convert, F.col("original_bytes")),
                "api_sha256": F.when(~convert, F.col("original_sha256")),
            }
        )
        .drop("length", "reason")
    )

