"""Files below a folder, listed and read by tasks.

Spark's file index holds an entry per file in the driver, and its readers open files one by one
through Hadoop; with millions of tiny files both cost more than the work on their bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import qualified, scratch_dir
from .reply_log import opened

# A file counts as this many bytes when files are dealt to tasks, and a task takes so many.
OPEN_COST, TASK_BYTES = 1 << 17, 1 << 27
# Bytes of files, and entries of a listing, that go on at once.
BATCH_BYTES, BATCH_ENTRIES = 1 << 23, 10_000

_ENTRY = "name string, length long, folder boolean"
_FILE = "path string, length long, content binary"


def hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def as_uri(path: str) -> str:
    """A path with the escapes of a Java URI, which keep letters outside ASCII."""
    return re.sub(
        r"[^\w\-.!~*'()/;:@&=+$,]",
        lambda c: quote(c[0]) if c[0] < "\x80" or unicodedata.category(c[0]) in ("Cc", "Zs", "Zl", "Zp") else c[0],
        path,
    )


def _listed(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of folders, without files of no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                parent = f"{name}/" if name else ""
                entries = [
                    (parent + e.base_name, e.size or 0, e.type == fs.FileType.Directory)
                    for e in store.get_file_info(fs.FileSelector(f"{base}/{name}"))
                    if not hidden(e.base_name) and (e.type == fs.FileType.Directory or e.size)
                ]
                for at in range(0, len(entries), BATCH_ENTRIES):
                    columns = zip(zip(*entries[at : at + BATCH_ENTRIES]), (pa.string(), pa.int64(), pa.bool_()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in columns], names=["name", "length", "folder"]
                    )

    return run


def _read(uri: str, prefix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        types = pa.string(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "length", "content"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows, size = [], 0
            for name, length in zip(*(batch.column(c).to_pylist() for c in ("name", "length"))):
                if rows and size + length > BATCH_BYTES:
                    yield out(rows)
                    rows, size = [], 0
                with store.open_input_stream(f"{base}/{name}") as file:
                    rows.append((f"{prefix}/{as_uri(name)}", length, file.read()))
                size += length
            if rows:
                yield out(rows)

    return run


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of every file below ``folder``, with the paths of Spark's file
    sources and without what those leave out: hidden names and files without bytes.

    Folders are listed by tasks, a level at a time, and the files dealt to tasks by number and
    size.  A folder that the tasks have no file system of their own for, a pattern, or a single
    file goes through Spark's own reader.
    """
    entries = _entries(spark, folder)
    if entries is None:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(folder)
            .select(F.col("_metadata.file_path").alias("path"), "length", "content")
        )
    uri, prefix, files = entries
    number, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = min(number, spark.sparkContext.defaultParallelism)
    parts = max(1, cores, -(-(size + number * OPEN_COST) // TASK_BYTES))
    return files.repartition(parts).mapInArrow(_read(uri, prefix), _FILE)


def _entries(spark: SparkSession, folder: str) -> tuple[str, str, DataFrame] | None:
    """(URI, path as Spark writes it, table of files) of a folder that tasks can list."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        return None
    if any(c in folder for c in "*?[]{}\\") or (uri := opened(spark, folder)) is None:
        return None
    prefix = qualified(spark, folder)
    store, base = fs.FileSystem.from_uri(uri)
    # A URI may stand for another path than it spells.
    if not prefix.endswith(base) or store.get_file_info([base])[0].type != fs.FileType.Directory:
        return None
    path, files, level, waiting = scratch_dir(spark, "listing"), [], spark.range(1).select(F.lit("").alias("name")), 1
    while waiting:
        table = f"{path}/{len(files)}"
        parts = min(waiting, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        level.repartition(parts).mapInArrow(_listed(uri), _ENTRY).write.parquet(table)
        entries = spark.read.schema(_ENTRY).parquet(table)
        files.append(entries.where("NOT folder").select("name", "length"))
        level = entries.where("folder").select("name")
        waiting = level.count()
    found = files[0]
    for more in files[1:]:
        found = found.unionByName(more)
    return uri, as_uri(prefix), found
