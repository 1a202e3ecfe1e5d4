"""Maps, arrays and specification tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ABSENT_SPEC


def spec_or_empty(specs: Column) -> Column:
    """A missing specification map counts as an empty one."""
    return F.coalesce(specs, F.create_map().cast("map<string,string>"))


def spec_side_by_side(expected: Column, answer: Column, absent: Column | None = None) -> Column:
    """For every expected field both values; a field the answer lacks reads as ``absent``.

    A field the answer holds as null stays null, extra answer fields are left out.
    """
    missing = F.lit(ABSENT_SPEC) if absent is None else absent
    return F.transform_values(
        expected,
        lambda name, value: F.struct(
            value.alias("ground_truth"),
            F.when(F.map_contains_key(answer, name), F.try_element_at(answer, name))
            .otherwise(missing)
            .alias("ai_answer"),
        ),
    )


def nonempty(items: Column) -> Column:
    """The list, or null when it holds nothing: an empty section is not shown."""
    return F.when(F.size(items) > 0, items)
