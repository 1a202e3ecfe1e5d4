"""Helpers shared by the operators: normal forms, row identity, tables between steps."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Characters outside ASCII that ``lower`` may change; unassigned ones count, as the
# regular expression engine and the case tables may know different Unicode versions.
_OTHER_UPPER = r"[[\p{IsUppercase}\p{Lt}\p{Cn}]&&[^A-Z]]"

# A table goes to every executor only up to this size, measured before it is sent.
BROADCAST_ROWS = 500_000

_scratch: list[tuple[SparkSession, str]] = []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is.

    ``translate`` goes through a map per character, so it is kept for texts in which
    ``lower`` could change anything else.
    """
    other = (F.octet_length(text) != F.length(text)) & text.rlike(_OTHER_UPPER)
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def pick(df: DataFrame, *names: str, carry: bool = False) -> DataFrame:
    """Just the named columns, found by exact name and position, so that further columns
    may have any name, even one that differs in case only.

    ``carry`` adds the whole row as ``_row``; :func:`unpack` gives it back.
    """
    by_place = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    chosen = [F.col(f"_c{df.columns.index(name)}").alias(name) for name in names]
    return by_place.select(*chosen, *([F.struct("*").alias("_row")] if carry else []))


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that :func:`pick` carried, under their own names."""
    return df.select(*[F.col(f"_row._c{i}").alias(name) for i, name in enumerate(columns)])


def clear(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _clear_all() -> None:
    for spark, path in _scratch:
        try:
            clear(spark, path)
        except Exception:  # the session may be gone; its folder then goes with the cluster's own
            pass


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, deleted when the application ends."""
    if not _scratch:
        atexit.register(_clear_all)
    path = work_dir(spark, purpose)
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and not again
    when an executor is lost."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is a written table of at most ``limit`` narrow
    rows, else as it is, which leaves a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches; by default ten thousand rows go at once, and
    both sides hold them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def drawn(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The ``rows`` rows with the smallest hash of the columns ``by``.  Of a large table only
    about twice as many leave their tasks."""
    mark = F.xxhash64(*by, F.lit(7))
    share = min(1.0, 2 * rows / max(1, df.count()))
    few = df if share == 1.0 else df.where(mark <= int(-(2**63) + share * 2**64))
    return few.orderBy(mark, *by).limit(rows)


def with_row_key(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``_key`` and ``_hash``, which name a row by its id and its text.

    Rows that agree in both are repeats of one row and get equal results.  A null id
    counts as the least long, a null text as empty.
    """
    return df.withColumns(
        {
            "_key": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))),
            "_hash": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 1 after division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
