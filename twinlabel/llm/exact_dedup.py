"""Exact duplicates by a content sort.

Rows are dealt to ranges of their normalised bytes by sampled splitters, sorted outside
memory, and each text is compared in full with its neighbour: that is what the group
boundary of a window over sorted rows does.

Splitters are made of a bounded head of the bytes and a digest of all of them, so a long
text stays small on its way to the driver.  Equal texts agree in both and end up side by
side.  A text that holds more than a quarter of a partition's share of all rows is cut
into pieces by document id: each piece finds its own keeper, and one row per piece then
decides which of them stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick, small, unpack, written

# Characters of a text that take part in the splitters.
SPLITTER_HEAD = 32


def _frequent(texts: DataFrame) -> DataFrame:
    """Digests of more than a quarter of a partition's share of all rows, each with its
    number of pieces; there are fewer than four times as many as partitions."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(texts.count() / (4 * partitions), 2)
    counts = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    return written(
        counts.select("_digest", F.ceil(F.col("_n") / share).cast("int").alias("_pieces")),
        "frequent-texts",
    )


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _sorted_groups(docs: DataFrame, carry: bool) -> DataFrame:
    rows = pick(docs, "doc_id", "text", carry=carry)
    text = f"_row._c{docs.columns.index('text')}" if carry else "text"
    digested = rows.withColumn("_digest", F.xxhash64(_normal(F.col("text"))))
    frequent = _frequent(digested.select("_digest"))
    dealt = (
        digested.join(small(frequent), "_digest", "left")
        .withColumns(
            {
                "_head": F.substring(_normal(F.col("text")), 1, SPLITTER_HEAD),
                "_piece": F.when(
                    F.col("_pieces").isNotNull(),
                    F.pmod(F.xxhash64("doc_id"), F.col("_pieces")).cast("int") + 1,
                ).otherwise(0),
            }
        )
        # A carried row has the text already.
        .drop("_pieces", *(["text"] if carry else []))
        .repartitionByRange("_head", "_digest", "_piece")
        .withColumn("_normal", _normal(F.col(text)))
    )
    equal = Window.partitionBy("_head", "_digest", "_piece", "_normal")
    by_id = equal.orderBy(F.col("doc_id").desc_nulls_last())
    group = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = dealt.select(
        *(["_row"] if carry else []),
        "doc_id",
        F.max("doc_id").over(group).alias("_keep"),
        F.count(F.lit(1)).over(group).alias("_size"),
        F.row_number().over(by_id).alias("_rank"),
        F.sha2("_normal", 256).alias("text_sha256"),
        "_piece",
        "_normal",
    )
    first_of_piece = (F.col("_piece") > 0) & (F.col("_rank") == 1)
    pieces = written(
        ranked.withColumn("_normal", F.when(first_of_piece, F.col("_normal"))), "content-sort"
    )
    whole = (
        pieces.where(first_of_piece)
        .groupBy("_normal", "text_sha256")
        .agg(F.max("_keep").alias("_all_keep"), F.sum("_size").alias("_all_size"))
        .select("text_sha256", "_all_keep", "_all_size")
    )
    return (
        pieces.drop("_normal")
        .join(small(written(whole, "cut-texts")), "text_sha256", "left")
        .withColumns(
            {
                "keep_id": F.when(F.col("_all_size").isNull(), F.col("_keep")).otherwise(
                    F.col("_all_keep")
                ),
                "group_size": F.coalesce("_all_size", "_size"),
            }
        )
        .withColumn("kept", (F.col("_rank") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: keep_id, group_size, kept and text_sha256 of its normalised text.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of
    equal texts the row with the largest doc_id stays; a null id is the smallest, and of
    rows that repeat the kept id one stays.  An empty table gives no rows.  Columns other
    than doc_id and text are not looked at, whatever their names.
    """
    return _sorted_groups(docs, carry=False).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, all columns as they are."""
    kept = _sorted_groups(docs, carry=True).where("kept")
    return unpack(kept, docs.columns)
