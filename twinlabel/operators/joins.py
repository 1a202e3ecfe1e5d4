"""Keyed joins of cases, images and replies, and the all-or-nothing gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HOT_SHARE = 0.001
HOT_ROWS = 100_000
NULL_PIECES = 4096


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE,
             min_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys that hold more than ``share`` of all rows (and more than ``min_rows``), or None.

    ``_pieces`` says into how many parts of about ``share`` a key is cut.  There are fewer than
    ``1 / share`` such keys and ``2 / share`` pieces, whatever the size of the data.  One pass
    over the key column feeds a mergeable sketch of frequent items, a bounded one per task; its
    counts are at most a tenth of ``share`` off, which only moves the cut.
    """
    top = math.ceil(1 / share)
    found = rows.select(F.col(key).alias("k")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(k, {top}, {10 * top})").alias("top")
    )
    seen = found.first()
    limit = max(seen["n"] * share, float(min_rows))
    hot = [(t["item"], math.ceil(t["count"] / limit)) for t in seen["top"]
           if t["item"] is not None and t["count"] > limit]
    if not hot:
        return None
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(hot, f"{key} {kind}, _pieces int")


def hot_key_join(rows: DataFrame, per_key: DataFrame, key: str, spread: str, how: str = "left",
                 share: float = HOT_SHARE, min_rows: int = HOT_ROWS) -> DataFrame:
    """Join rows with a table of one row per key; a key with very many rows is split.

    The rows of a hot key are spread over its pieces by the hash of ``spread``,
    a column that differs between them; the one row of the other side is
    repeated per piece.  All other keys have a single piece.  Null keys match
    nothing and are spread over ``NULL_PIECES``.
    """
    hot = hot_keys(rows, key, share, min_rows)
    pieces = F.lit(1)
    left, right = rows, per_key
    if hot is not None:
        pieces = F.coalesce("_pieces", F.lit(1))
        left, right = (side.join(F.broadcast(hot), key, "left") for side in (rows, per_key))
    spread_over = F.when(F.col(key).isNull(), NULL_PIECES).otherwise(pieces)
    left = left.withColumn("_piece", F.pmod(F.hash(spread), spread_over)).drop("_pieces")
    right = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return left.join(right, [key, "_piece"], how).drop("_piece")


def case_join(cases: DataFrame, facts: DataFrame, name: str, key: str = "id",
              latest: Column | None = None, how: str = "left", spread: str = "pos") -> DataFrame:
    """Cases with the facts of the same id as struct ``name``.

    Of several facts with one id the greatest ``latest`` counts (all columns in
    order when none is given).  Every case row stays, copies of an id included;
    ``spread`` is a column that differs between them.
    """
    columns = [c for c in facts.columns if c != key]
    order = F.struct(*columns) if latest is None else latest
    one = (
        facts.select(key, F.struct(*columns).alias(name), order.alias("_order"))
        .groupBy(key)
        .agg(F.max_by(name, "_order").alias(name))
    )
    return hot_key_join(cases, one, key, spread, how)


def last_of_each(cases: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row per id: the content of its last row."""
    rest = [c for c in cases.columns if c not in (key, order)]
    return (
        cases.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("_last"))
        .select(key, "_last.*")
    )


def last_prepared(cases: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Each case row carries the content of the last row with its id."""
    last = last_of_each(cases, key, order)
    return hot_key_join(cases.select(key, order), last, key, order, "inner")


def spec_join(cases: DataFrame, replies: DataFrame, expected: str, answer: str,
              key: str = "id") -> DataFrame:
    """Long form of the specification comparison: one row per case and expected field."""
    fields = cases.select(key, F.explode(expected).alias("field", "ground_truth"))
    given = replies.select(key, F.explode(answer).alias("field", "ai_answer"))
    marked = given.withColumn("provided", F.lit(True))
    return fields.join(marked, [key, "field"], "left").withColumn(
        "provided", F.coalesce("provided", F.lit(False))
    )


def prepared_rows(cases: DataFrame, prepared: DataFrame, key: str = "id", spread: str = "pos",
                  ) -> DataFrame:
    """Cases with a prepared record."""
    return hot_key_join(cases, prepared.select(key).distinct(), key, spread, "left_semi")


def unprepared_rows(cases: DataFrame, prepared: DataFrame, key: str = "id", spread: str = "pos",
                    ) -> DataFrame:
    """Cases without a prepared record."""
    return hot_key_join(cases, prepared.select(key).distinct(), key, spread, "left_anti")


def all_pass(df: DataFrame, ok: Column) -> Column:
    """True when ``ok`` holds on every row of ``df`` (also on none).

    A scalar subquery over one aggregate row: no join and no shuffle of rows.
    """
    return F.coalesce(
        df.agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).scalar(), F.lit(True)
    )


def all_ok(df: DataFrame, ok: Column) -> bool:
    """:func:`all_pass`, asked now."""
    held = df.agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).first()["ok"]
    return held is not False


def global_gate(df: DataFrame, ok: Column, column: str = "gate_open") -> DataFrame:
    """Every row learns whether all rows passed."""
    return df.withColumn(column, all_pass(df, ok))
