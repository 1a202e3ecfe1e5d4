"""Sources.  Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CATEGORIES, CORE_FOLDER, PACK_FOLDERS, PROVIDERS
from ..functions.encoding import byte_length, sha256
from ..functions.images import file_format, image_size
from ..operators.joins import hot_key_join
from ..schemas import DATASET, LABEL_REQUEST, MODEL_REPLY, PAGE
from .json_records import read_json_records
from .small_files import read_files


def read_eval_dataset(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole JSON documents, one row each: header fields and ``cases``."""
    return (
        spark.read.schema(DATASET)
        .option("multiLine", True)
        .option("encoding", "UTF-8")
        .json(list(paths))
    )


def dataset_header(dataset: DataFrame) -> DataFrame:
    return dataset.select("version", "purpose", "policy")


def explode_cases(dataset: DataFrame) -> DataFrame:
    """One row per case with its position in the file; header fields are repeated."""
    return dataset.select(
        F.col("version").alias("dataset_version"), F.posexplode("cases").alias("pos", "case")
    ).select("dataset_version", "pos", "case.*")


def read_large_dataset(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(header, cases) of datasets too large for one task each; see ``read_json_records``.

    ``header`` has one row per file; ``cases`` are those of ``explode_cases`` with their ``file``.
    """
    rows = read_json_records(spark, list(paths), DATASET, "cases")
    fields = ("version", "purpose", "policy")
    header = rows.groupBy("file").agg(
        *[F.first(f"doc.{name}", ignorenulls=True).alias(name) for name in fields]
    )
    cases = rows.select("file", "pos", F.explode("doc.cases").alias("case"))
    versions = header.select("file", F.col("version").alias("dataset_version"))
    cases = hot_key_join(cases, versions, "file", "pos")
    return header, cases.select("file", "dataset_version", F.col("pos").cast("int").alias("pos"), "case.*")


def category_pack_map(spark: SparkSession) -> DataFrame:
    """Category -> folder of its reference text; ``unknown`` shares general-repair."""
    rows = [(c, PACK_FOLDERS[c]) for c in CATEGORIES]
    return spark.createDataFrame(rows, "category string, folder string")


def _read_whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """folder, text: every file below ``folder`` whole, with the name of its own folder."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select(
            F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+\z", 1).alias("folder"),
            F.col("value").alias("text"),
        )
    )


def read_reference_packs(spark: SparkSession, folder: str) -> DataFrame:
    """category, text: the reference text of every category, one file per folder."""
    files = _read_whole_files(spark, folder)
    return category_pack_map(spark).join(files, "folder").select("category", "text")


def read_core_pack(spark: SparkSession, folder: str) -> DataFrame:
    """text: the one shared reference text."""
    return _read_whole_files(spark, f"{folder.rstrip('/')}/{CORE_FOLDER}").select("text")


def provider_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PROVIDERS)]
    return spark.createDataFrame(
        rows, "ordinal int, provider string, model string, label string, note string"
    )


def read_label_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Labelling requests; a missing image reads as an empty one.

    From JSON an image that is not a string reads as empty, too, and ``body_ok``
    is false for a body that is not JSON at all.
    """
    if fmt == "json":
        loose = LABEL_REQUEST.replace("image string", "image variant") + ", _broken string"
        image = F.when(F.schema_of_variant("image") == "STRING", F.col("image").cast("string"))
        requests = (
            spark.read.schema(loose)
            .option("columnNameOfCorruptRecord", "_broken")
            .json(path)
            .withColumns({"image": image, "body_ok": F.col("_broken").isNull()})
            .drop("_broken")
        )
    else:
        requests = spark.read.schema(LABEL_REQUEST).format(fmt).load(path)
    return requests.withColumn("image", F.coalesce("image", F.lit("")))


def read_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of every file below ``folder`` from one read of its bytes: length, hash, format,
    and the edges that its header states.

    A file without a readable header (also AVIF) has null edges.
    """
    content = F.col("content")
    return (
        read_files(spark, folder)
        .select(
            "path",
            "length",
            byte_length(content).cast("long").alias("original_bytes"),
            sha256(content).alias("original_sha256"),
            file_format(content).alias("original_format"),
            image_size(content).alias("_size"),
        )
        .select("*", "_size.width", "_size.height")
        .drop("_size")
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages; optional columns a table lacks are null."""
    pages = spark.read.parquet(path)
    for name, kind in (part.split() for part in PAGE.split(", ")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages


def read_model_replies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed raw reply bodies with their HTTP status."""
    return spark.read.schema(MODEL_REPLY).format(fmt).load(path)
