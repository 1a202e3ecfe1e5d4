"""Row shaping around costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Where several later expressions read a column, the optimizer may write its
    definition into each of them and so parse or scan the same text many times.
    A one-row generator between the two keeps them apart; it moves no data.
    """
    names = [c for c in df.columns if c not in columns]
    return df.select(
        *names, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    )


def explode_items(df: DataFrame, items: str, *keep: str, value: str = "item") -> DataFrame:
    """One row per list element with its index; empty lists give no row."""
    # The outer form keeps Spark from adding a filter that computes the list a second time.
    return df.select(*keep, F.posexplode_outer(items).alias("index", value)).where(
        F.col("index").isNotNull()
    )
