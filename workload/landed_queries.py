"""Readers, error texts and the split join over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlabel.constants import CATEGORIES, CORE_FOLDER, PACK_FOLDERS
from twinlabel.functions import text as T
from twinlabel.functions.images import PNG_END
from twinlabel.functions.urls import og_image
from twinlabel.operators.joins import hot_key_join
from twinlabel.operators.reports import numbered
from twinlabel.plans.evaluation import evaluation_run
from twinlabel.plans.images import image_preflight as preflight
from twinlabel.session import qualified, scratch_dir
from twinlabel.sources.readers import (
    category_pack_map,
    explode_cases,
    read_core_pack,
    read_eval_dataset,
    read_image_files,
    read_large_dataset,
    read_pages,
    read_reference_packs,
)

from .bindings import CASES_SQL, as_passed, cases_and_facts
from .evaluation_queries import _API_ERROR_SQL, _CATEGORY_HIT
from .registry import query, table


@query("""
  SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'https://img.example/' || page_id || '.jpg' END
    AS preview, md5(html) AS html_md5, CAST(NULL AS VARCHAR) AS image_hint FROM pages""")
def page_preview(spark, sf_dir):
    """Pages landed with a preview tag in either attribute order, and a fifth without one."""
    path = scratch_dir(spark, "pages")
    link = F.concat(F.lit("https://img.example/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    first = F.concat(F.lit('<meta property="og:image" content="'), link, F.lit('">'))
    second = F.concat(F.lit('<meta content="'), link, F.lit('" property="og:image">'))
    tag = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(
        F.when(F.col("page_id") % 2 == 0, first).otherwise(second)
    )
    table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat(tag, "html").alias("html"), F.length(tag).alias("tag_chars")
    ).write.parquet(path)
    return read_pages(spark, path).select(
        "page_id",
        og_image(F.col("html")).alias("preview"),
        F.md5(F.expr("substring(html, tag_chars + 1)")).alias("html_md5"),
        "image_hint",
    )


@query("""
  SELECT event_id, event_type || ': ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS error
  FROM events""")
def error_texts(spark, sf_dir):
    """Every event as an error of its type; a third of them without a message."""
    message = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", T.error_text(F.col("event_type"), message).alias("error")
    )


@query("""
  WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 1
               WHEN l_linenumber >= 6 THEN NULL ELSE l_suppkey END AS k FROM lineitem)
  SELECT l_orderkey, l_linenumber, k, s_name FROM l LEFT JOIN supplier ON k = s_suppkey""")
def hot_key_lines(spark, sf_dir):
    """Line items of which a third share one supplier and others have none; the hot key is
    cut into pieces at any size of the table."""
    key = (
        F.when(F.col("l_linenumber") <= 2, F.lit(1).cast("long"))
        .when(F.col("l_linenumber") < 6, F.col("l_suppkey"))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("k"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return hot_key_join(lines, suppliers, "k", "l_orderkey", share=0.05, min_rows=10)


# ---------------------------------------------------------------- dataset documents
# A block of a thousand documents is a dataset of one JSON text; ids are its cases.
_DATASETS_SQL = """
  SELECT 'block ' || doc_id // 1000 AS dataset_version,
         row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) - 1 AS pos,
         'case ' || doc_id AS id, lang AS category_group, source AS source_type,
         text AS item_name, CAST(n_chars AS VARCHAR) AS chars
  FROM documents"""


def landed_datasets(spark, sf_dir):
    """Datasets as files, one JSON text each."""
    path = f"{scratch_dir(spark, 'datasets')}/json"
    docs = table(spark, sf_dir, "documents")
    case = F.struct(
        F.concat(F.lit("case "), F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("category_group"),
        F.col("source").alias("source_type"),
        F.struct(
            F.lit("fasteners").alias("category"),
            F.col("text").alias("item_name"),
            F.create_map(F.lit("chars"), F.col("n_chars").cast("string")).alias("specifications"),
        ).alias("ground_truth"),
    )
    policy = F.struct(
        F.lit(False).alias("generated_images_allowed"), F.lit(True).alias("ground_truth_required")
    )
    blocks = docs.groupBy(F.floor(F.col("doc_id") / 1000).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", F.to_json(case).alias("case")))).alias("cases")
    )
    document = F.concat(
        F.lit('{"version": "block '), F.col("block").cast("string"), F.lit('", "cases": ['),
        F.array_join("cases.case", ", "), F.lit('], "policy": '), F.to_json(policy), F.lit("}"),
    )
    # One text per file.
    blocks.select(document).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _dataset_columns(cases):
    return cases.select(
        "dataset_version",
        F.col("pos").cast("long").alias("pos"),
        "id",
        "category_group",
        "source_type",
        F.col("ground_truth.item_name").alias("item_name"),
        F.element_at("ground_truth.specifications", "chars").alias("chars"),
    )


@query(_DATASETS_SQL)
def dataset_cases(spark, sf_dir):
    """Cases of landed datasets, a file read whole by one task."""
    return _dataset_columns(explode_cases(read_eval_dataset(spark, landed_datasets(spark, sf_dir))))


@query(_DATASETS_SQL)
def large_dataset_cases(spark, sf_dir):
    """The same cases, files cut into ranges of bytes."""
    header, cases = read_large_dataset(spark, landed_datasets(spark, sf_dir))
    return _dataset_columns(cases)


@query(f"""
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS id_row,
         row_number() OVER (ORDER BY dataset_version, pos) - 1 AS dataset_row
  FROM (SELECT dataset_version, pos, id FROM ({_DATASETS_SQL}))""")
def case_order(spark, sf_dir):
    """Both orders of a report, by id and by place in the dataset, as row numbers."""
    cases = explode_cases(read_eval_dataset(spark, landed_datasets(spark, sf_dir))).select(
        "dataset_version", F.col("pos").cast("long").alias("pos"), "id"
    )
    by_id = numbered(cases, "id", name="id_row")
    return numbered(by_id, "dataset_version", "pos", name="dataset_row")


# ---------------------------------------------------------------- text folders
_FOLDERS = sorted(set(PACK_FOLDERS.values()))


@query(f"""
  WITH f AS (SELECT unnest({_FOLDERS}) AS folder, unnest(range({len(_FOLDERS)})) AS n),
  t AS (SELECT folder, string_agg(n_name, E'\\n' ORDER BY n_nationkey) || E'\\n' AS text
        FROM nation JOIN f ON n = n_regionkey GROUP BY folder),
  c AS (SELECT unnest({list(CATEGORIES)}) AS category, unnest({[PACK_FOLDERS[c] for c in CATEGORIES]}) AS folder)
  SELECT category, folder, text FROM c JOIN t USING (folder)
  UNION ALL SELECT NULL, '{CORE_FOLDER}', string_agg(r_name, E'\\n' ORDER BY r_regionkey) || E'\\n' FROM region""")
def reference_packs(spark, sf_dir):
    """A text file per folder with the nations of a region, and one with all regions."""
    path = f"{scratch_dir(spark, 'packs')}/texts"
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    for n, folder in enumerate(_FOLDERS):
        rows = nations.where(F.col("n_regionkey") == n).select("n_name")
        rows.coalesce(1).write.text(f"{path}/{folder}")
    table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(
        f"{path}/{CORE_FOLDER}"
    )
    packs = category_pack_map(spark).join(read_reference_packs(spark, path), "category")
    core = read_core_pack(spark, path).select(
        F.lit(None).cast("string").alias("category"), F.lit(CORE_FOLDER).alias("folder"), "text"
    )
    return packs.select("category", "folder", "text").unionByName(core)


# ---------------------------------------------------------------- image files
def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of a folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hadoop leaves out the empty host of a local path.
        target, base = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))
        made = set()
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                path = f"{base}/{name.as_py()}"
                if (parent := path.rpartition("/")[0]) not in made:
                    target.create_dir(parent, recursive=True)
                    made.add(parent)
                with target.open_output_stream(path) as out:
                    out.write(content.as_py())
            yield batch.select(["name"])

    # A folder must be there before the first file is.
    files.select("name").limit(0).write.parquet(f"{folder}/_made")
    files.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def _bytes_of(number, size, little=False):
    """Hex of an unsigned number."""
    text = F.lpad(F.hex(number.cast("long")), 2 * size, "0")
    if not little:
        return text
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])


@query("""
  WITH f AS (SELECT doc_id, 100 + n_chars % 700 AS w, 150 + doc_id % 400 AS h, doc_id % 7 AS k,
                    doc_id % 5 AS t FROM documents),
  s AS (SELECT *, CASE WHEN k = 6 THEN 'empty_body' WHEN k = 5 THEN 'undecodable'
                       WHEN w < 200 OR h < 200 THEN 'too_small: ' || w || 'x' || h
                       WHEN t = 0 THEN 'not_an_image: text/html' END AS error FROM f)
  SELECT doc_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'download_failed' END AS status, error,
         CASE WHEN k < 5 THEN w END AS width, CASE WHEN k < 5 THEN h END AS height,
         CASE WHEN k < 6 THEN ['PNG', 'JPEG', 'GIF', 'BMP', 'WEBP', 'PNG'][k + 1] END AS original_format,
         CASE WHEN k < 6 THEN [45, 23, 11, 26, 30, 33][k + 1] END AS original_bytes,
         k IN (3, 6) AS converted,
         ['image/png', 'image/jpeg', 'image/gif', 'image/jpeg', 'image/webp', 'image/png',
          'image/jpeg'][k + 1] AS mime
  FROM s""")
def image_preflight(spark, sf_dir):
    """A tiny image file per document, in five formats, cut off or without a byte; in 256 folders,
    which tasks list side by side."""
    folder = qualified(spark, f"{scratch_dir(spark, 'images')}/files")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (100 + F.col("n_chars") % 700).alias("w"), (150 + F.col("doc_id") % 400).alias("h")
    )
    w, h, kind = F.col("w"), F.col("h"), F.col("doc_id") % 7
    header = F.concat(F.lit("49484452"), _bytes_of(w, 4), _bytes_of(h, 4), F.lit("0802000000"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), header, _bytes_of(F.crc32(F.unhex(header)), 4))
    jpeg = F.concat(
        F.lit("FFD8FFE1000441"), F.lit("42FFC0000B08"), _bytes_of(h, 2), _bytes_of(w, 2),
        F.lit("01011100FFD9"),
    )
    gif = F.concat(F.lit("474946383961"), _bytes_of(w, 2, True), _bytes_of(h, 2, True), F.lit("00"))
    bmp = F.concat(F.lit("424D" + "00" * 16), _bytes_of(w, 4, True), _bytes_of(h, 4, True))
    webp = F.concat(
        F.lit("524946461600000057454250565038580A00000000000000"),
        _bytes_of(w - 1, 3, True), _bytes_of(h - 1, 3, True),
    )
    content = (
        F.when(kind == 0, F.concat(png, F.lit(PNG_END))).when(kind == 1, jpeg).when(kind == 2, gif)
        .when(kind == 3, bmp).when(kind == 4, webp).when(kind == 5, png).otherwise("")
    )
    part = F.pmod(F.col("doc_id"), F.lit(256)).cast("string")
    name = F.concat(part, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".img"))
    write_files(docs.select(name.alias("name"), F.unhex(content).alias("content")), folder)
    manifest = docs.select(
        "doc_id",
        F.concat(F.lit(f"{folder}/"), name).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, "Text/HTML; charset=x").otherwise("image/png").alias("content_type"),
    )
    return preflight(read_image_files(spark, folder), manifest).select(
        "doc_id", "status", "error", "width", "height", "original_format", "original_bytes",
        F.col("converted_for_api").alias("converted"), "mime",
    )


# ---------------------------------------------------------------- whole runs
@query(f"""
  WITH c AS ({CASES_SQL}), e AS (SELECT *, {_API_ERROR_SQL} AS err FROM c)
  SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS row,
         CAST(doc_id AS VARCHAR) AS id, doc_id AS pos,
         CASE WHEN err IS NULL THEN 'ok' ELSE 'failed' END AS api_status, err AS api_error,
         CASE WHEN err IS NULL THEN {_CATEGORY_HIT} END AS category_match,
         CASE WHEN err IS NULL THEN lang || ' ' || source END AS purchase_name,
         'passed_all_images' AS preflight, count(*) FILTER (err IS NOT NULL) OVER () AS failures,
         (SELECT count(*) FROM documents) AS repeated_images,
         (SELECT count(*) FROM documents WHERE source <> 'src9') AS repeated_replies
  FROM e""")
def gated_run(spark, sf_dir):
    """A gated evaluation from its gates to its report as JSON, in the order of ids.  Of two
    images per case, and two replies of most, the last one counts."""
    cases, images, replies = cases_and_facts(spark, sf_dir)
    images, replies = as_passed(images), replies.withColumn("seq", F.lit(2))
    older = (
        table(spark, sf_dir, "documents").where("source <> 'src9'")
        .select(F.col("doc_id").cast("string").alias("id"), F.lit(500).alias("http_status"),
                F.lit("{}").alias("body"), F.lit(1).alias("seq"))
    )
    failed = images.withColumns({"status": F.lit("failed"), "error": F.lit("x"), "seq": F.lit(1)})
    report, header = evaluation_run(
        _header(spark), cases, failed.unionByName(images.withColumn("seq", F.lit(2))),
        older.unionByName(replies), f"{scratch_dir(spark, 'gated-run')}/report", "m",
        gated=True, latest="seq",
    )
    verdict = header.select("preflight", "failures", "repeated_images", "repeated_replies")
    return report.join(F.broadcast(verdict)).select(
        "row", "id", "pos", "api_status", "api_error",
        F.col("result.category_match_strict").alias("category_match"),
        F.col("result.ground_truth_purchase_name").alias("purchase_name"), "preflight", "failures",
        "repeated_images", "repeated_replies",
    )


@query(f"""
  WITH c AS ({CASES_SQL}),
  e AS (SELECT *, coalesce({_API_ERROR_SQL}, CASE WHEN source IN ('src2', 'src6') THEN 'x' END) AS err
        FROM c)
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN image_reason <> 'ok' THEN 'skipped' WHEN err IS NULL THEN 'ok' ELSE 'failed' END
           AS api_status,
         count(*) FILTER (image_reason <> 'ok' OR err IS NOT NULL) OVER () AS failures
  FROM e""")
def isolated_run(spark, sf_dir):
    """An isolated evaluation from its gates to its report, in the order of the dataset."""
    cases, images, replies = cases_and_facts(spark, sf_dir)
    report, header = evaluation_run(
        _header(spark), cases, images, replies,
        f"{scratch_dir(spark, 'isolated-run')}/report", "m", gated=False,
    )
    return report.join(F.broadcast(header.select("failures"))).select("row", "id", "api_status", "failures")


def _header(spark):
    """The header of a dataset whose policy holds."""
    flags = {
        "generated_images_allowed": False, "ground_truth_required": True,
        "ground_truth_established_before_inference": True,
    }
    policy = F.struct(*[F.lit(value).alias(name) for name, value in flags.items()])
    return spark.range(1).select(F.lit("v1").alias("version"), policy.alias("policy"))
