"""Side-by-side comparison of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORY_LABELS, EVIDENCE_LABELS, PROVIDER_CODES
from ..operators.lookups import label_of
from ..functions.nested import nonempty
from ..functions.text import join_names


def compare_providers(results: DataFrame, key: str = "image_id", provider: str = "provider",
                      value: str = "response", order=("ts", "request_id"),
                      providers=PROVIDER_CODES) -> DataFrame:
    """One row per image, one column per provider with its newest value, null if none.

    One aggregate with a closed provider list: a single shuffle, and a hot image
    is folded in the map tasks.
    """
    at = F.struct(*order)
    picks = [
        F.max_by(F.when(F.col(provider) == p, F.col(value)), F.when(F.col(provider) == p, at))
        .alias(p)
        for p in providers
    ]
    return results.where(F.col(provider).isin(*providers)).groupBy(key).agg(*picks)


def result_sections(results: DataFrame, response: str = "response") -> DataFrame:
    """The sections of a result card; lists that hold nothing are null, and each specification
    has the label of its evidence level beside it."""
    r = F.col(response)["result"]
    labelled = F.transform(
        r["specifications"],
        lambda item: item.withField(
            "evidence_label", label_of(item["evidence_level"], EVIDENCE_LABELS)
        ),
    )
    return results.withColumns(
        {
            "routed_label": label_of(F.col(response)["routing"]["category"], CATEGORY_LABELS),
            "final_label": label_of(r["category"], CATEGORY_LABELS),
            "names_line": join_names(nonempty(r["common_names"])),
            "specifications": nonempty(labelled),
            "uncertain_fields": nonempty(r["uncertain_fields"]),
        }
    )
