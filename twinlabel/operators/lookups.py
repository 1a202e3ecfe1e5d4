"""Lookups of small tables: reference texts, providers, labels, MIME types."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES, CATEGORY_LABELS, EVIDENCE_LABELS, PROVIDERS

BROADCAST_BYTES = 64 * 1024 * 1024


def lookup_join(
    df: DataFrame, table: DataFrame, on: str, how: str = "left", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join a lookup table, broadcast only when its measured size is within ``max_bytes``.

    The size is one aggregate over the lookup table.  A larger table takes the
    planner's own join: both sides are then shuffled on the key, and AQE splits
    a hot key of ``df``.
    """
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return df.join(F.broadcast(table) if size <= max_bytes else table, on, how)


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def label_of(code: Column, labels: dict) -> Column:
    """The label of a code; an unknown code stands for itself."""
    return F.coalesce(F.try_element_at(literal_map(labels), code), code)


# Providers are rows (code, model, label, note) in display order; every function that looks one
# up takes another table of them.
Providers = Sequence[tuple[str, str, str, str]]


def attach_labels(df: DataFrame, providers: Providers = PROVIDERS, **columns: str) -> DataFrame:
    """Add ``<column>_label`` for each ``column='category'|'evidence'|'provider'``."""
    tables = {
        "category": CATEGORY_LABELS,
        "evidence": EVIDENCE_LABELS,
        "provider": {code: label for code, _, label, _ in providers},
    }
    return df.withColumns(
        {f"{name}_label": label_of(F.col(name), tables[kind]) for name, kind in columns.items()}
    )


def provider_model(provider: Column, providers: Providers = PROVIDERS) -> Column:
    return F.try_element_at(literal_map({p[0]: p[1] for p in providers}), provider)


def provider_ordinal(provider: Column, providers: Providers = PROVIDERS) -> Column:
    """Position in the fixed display order; unknown providers come last."""
    table = literal_map({p[0]: i for i, p in enumerate(providers)})
    return F.coalesce(F.try_element_at(table, provider), F.lit(len(providers)))


def attach_provider(df: DataFrame, providers: Providers = PROVIDERS) -> DataFrame:
    """Rows of known providers with model, label and display position."""
    return (
        df.withColumn("model", provider_model(F.col("provider"), providers))
        .where(F.col("model").isNotNull())
        .transform(attach_labels, providers, provider="provider")
        .withColumn("provider_ordinal", provider_ordinal(F.col("provider"), providers))
    )


def unknown_provider_rows(df: DataFrame, providers: Providers = PROVIDERS) -> DataFrame:
    """The rows ``attach_provider`` leaves out."""
    return df.where(provider_model(F.col("provider"), providers).isNull())


def one_text_per_category(packs: DataFrame) -> DataFrame:
    """At most one row per known category, so the table has six rows at the most."""
    return (
        packs.where(F.col("category").isin(*CATEGORIES))
        .groupBy("category")
        .agg(F.min("text").alias("pack"))
    )


def attach_category_pack(df: DataFrame, packs: DataFrame, category: str = "category") -> DataFrame:
    """Add ``pack``, the reference text of the row's category; null if there is none."""
    table = one_text_per_category(packs).withColumnRenamed("category", category)
    return lookup_join(df, table, category)


def attach_core_pack(df: DataFrame, core: DataFrame) -> DataFrame:
    """Add ``core``, the one text shared by every row.

    A scalar subquery: it fails on a table of two rows and needs no join.
    """
    return df.withColumn("core", core.select("text").scalar())
