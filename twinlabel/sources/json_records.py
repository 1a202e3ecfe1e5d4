"""Large JSON documents, read by several tasks.

A document is one object with a list of records in it, however long and on however many lines.
The text source cuts a file into byte ranges and a range into pieces at ``}``, which a JSON
string may hold, too.  Whether a piece begins inside a string follows from the number of
quotation marks before it, and its depth from the brackets outside strings before it; both are
sums over pieces in a range and over ranges in a file.  A record ends where a piece brings the
depth back to that of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

# Depth inside the list of records: the document and the list.
_LIST_DEPTH = 2


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _before(value: Column) -> Column:
    """Sum of ``value`` over the pieces of a range before this one."""
    ordered = Window.partitionBy("file", "start").orderBy("at")
    return F.coalesce(F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _carried(pieces: DataFrame, name: str) -> DataFrame:
    """``pieces`` with ``name`` summed over all pieces of the file before each, as ``<name>_before``.

    The ranges of a file are few: one row each.
    """
    totals = pieces.groupBy("file", "start").agg(F.sum(name).alias("_total"))
    ordered = Window.partitionBy("file").orderBy("start")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("file").alias("_file"), F.col("start").alias("_start"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry"),
    )
    same = (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start"))
    return pieces.join(totals, same).withColumn(
        f"{name}_before", F.col("_carry") + _before(F.col(name))
    ).drop("_file", "_start", "_carry")


def read_json_records(spark: SparkSession, paths: list[str] | str, schema: str, records: str) -> DataFrame:
    """Rows (file, pos, doc) of JSON documents whose field ``records`` is a list of objects.

    ``doc`` has the document's ``schema`` with at most one record, the one at ``pos``; the fields
    around the list come with the first or the last row of a file.  The list must be the
    document's only list of objects.  A document without records gives one row.  What does not
    parse is null, as in Spark's own reader.
    """
    raw = (
        spark.read.option("lineSep", "}")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("piece"),
        )
    )
    # Written, so that the numbers of the pieces hold for all that follows.
    path = f"{scratch_dir(spark, 'json')}/pieces"
    raw.write.parquet(path)
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    pieces = _carried(
        spark.read.schema(raw.schema).parquet(path).withColumn("quotes", _count(plain, '"')), "quotes"
    )
    inside = F.col("quotes_before") % 2 == 1
    closed = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    # Strings go; one that the piece ends in goes to the end.
    outside = F.regexp_replace(
        F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), plain), r'(?s)"[^"]*("|\z)', ""
    )
    deeper = _count(outside, "{[") - _count(outside, "}]") - F.when(closed, 1).otherwise(0)
    pieces = _carried(
        pieces.withColumns({"closed": closed, "deeper": deeper}), "deeper"
    ).withColumn("depth", F.col("deeper_before") + F.col("deeper"))
    pieces = pieces.withColumn("ends", (F.col("closed") & (F.col("depth") == _LIST_DEPTH)).cast("int"))
    groups = (
        _carried(pieces, "ends")
        .groupBy("file", F.col("ends_before").alias("pos"))
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("_pieces"),
            F.max("ends").alias("_record"),
            F.min("depth").alias("_depth"),
        )
    )
    text = F.array_join(F.col("_pieces.piece"), "}")
    # A record lost its last bracket to the cut, and so did the document, unless there is
    # something after it: that piece was counted as if it ended in a bracket of its own.
    first = F.col("pos") == 0
    opened = F.when(first, text).otherwise(
        F.concat(F.lit(f'{{"{records}":['), F.regexp_replace(text, r"^\s*,", ""))
    )
    end = F.when(F.col("_record") == 1, "}]}").when(F.col("_depth") == 0, "}").otherwise("")
    whole = F.concat(opened, end)
    rows = groups.select("file", "pos", "_record", F.from_json(whole, schema).alias("doc")).where(
        "_record = 1 OR doc IS NOT NULL OR pos = 0"
    ).drop("_record")
    # Parsed once, however often the rows are read; a reader of few fields reads only those.
    rows.write.parquet(f"{path}-rows")
    return spark.read.schema(rows.schema).parquet(f"{path}-rows")
