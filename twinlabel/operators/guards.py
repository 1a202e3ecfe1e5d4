"""Checks of structured replies, on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CATEGORIES,
    GUARD_ARRAYS,
    GUARD_STRINGS,
    IDENTIFICATION_FIELDS,
    ROUTING_FIELDS,
)
from ..functions.replies import field, is_object, is_string


def is_category(value: Column, categories=CATEGORIES) -> Column:
    """Membership in the closed set; null is not a member."""
    return F.coalesce(value.isin(*categories), F.lit(False))


def _holds_category(reply: Column) -> Column:
    # A number, boolean, list or object never reads as a category name.
    return is_category(field(reply, "$.category", "string"))


def guard_routing(reply: Column) -> Column:
    """A routing reply is usable: known category, ``reason`` a string (may be empty)."""
    return _holds_category(reply) & is_string(field(reply, "$.reason"))


def guard_identification(reply: Column) -> Column:
    """An identification reply is usable: the eight guarded fields have their types."""
    ok = _holds_category(reply)
    for name in GUARD_STRINGS:
        ok = ok & is_string(field(reply, f"$.{name}"))
    for name in GUARD_ARRAYS:
        ok = ok & field(reply, f"$.{name}", "array<variant>").isNotNull()
    return ok


def _wrong_type(value: Column, rule) -> Column:
    """Whether a present value has another type than its rule asks for."""
    if not isinstance(rule, list):
        return ~is_string(value)
    items = F.try_variant_get(value, "$", "array<variant>")
    if rule[0] is str:
        return F.coalesce(F.exists(items, lambda i: ~is_string(i)), F.lit(True))
    return items.isNull()


def _closed_object_breaks(item: Column, rules: dict) -> Column:
    keys = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))
    broken = ~is_object(item) | (F.size(F.array_except(keys, _names(rules))) > 0)
    for name, rule in rules.items():
        value = field(item, f"$.{name}")
        broken = broken | ~is_string(value)
        if isinstance(rule, tuple):
            broken = broken | ~is_category(value.cast("string"), rule)
    return F.coalesce(broken, F.lit(True))


def _names(rules: dict) -> Column:
    return F.array(*[F.lit(n) for n in rules])


def schema_violations(reply: Column, rules: dict = IDENTIFICATION_FIELDS) -> Column:
    """Codes of every way a reply departs from the full contract, in contract order.

    ``not_an_object``; per field ``missing:f``, ``type:f`` or ``enum:f``;
    ``item:f`` when a list of objects holds a malformed one; ``extra:k`` for
    each key the contract does not name.
    """
    codes = []
    for name, rule in rules.items():
        value = field(reply, f"$.{name}")
        code = F.when(value.isNull(), F.lit(f"missing:{name}")).when(
            _wrong_type(value, rule), F.lit(f"type:{name}")
        )
        if isinstance(rule, tuple):
            code = code.when(~is_category(value.cast("string"), rule), F.lit(f"enum:{name}"))
        elif isinstance(rule, list) and isinstance(rule[0], dict):
            items = F.try_variant_get(value, "$", "array<variant>")
            code = code.when(
                F.exists(items, lambda i: _closed_object_breaks(i, rule[0])),
                F.lit(f"item:{name}"),
            )
        codes.append(code)
    keys = F.map_keys(F.try_variant_get(reply, "$", "map<string,variant>"))
    extra = F.transform(
        F.array_sort(F.array_except(keys, _names(rules))),
        lambda k: F.concat(F.lit("extra:"), k),
    )
    return F.when(~is_object(reply), F.array(F.lit("not_an_object"))).otherwise(
        F.concat(F.array_compact(F.array(*codes)), extra)
    )


def routing_violations(reply: Column) -> Column:
    return schema_violations(reply, ROUTING_FIELDS)


def consistency_violations(result: Column) -> Column:
    """Rules between fields of a typed identification result that the contract only states."""
    unusable = F.coalesce(result["image_quality"] == "unusable", F.lit(False))
    unidentifiable = F.coalesce(
        result["identification_status"] == "unidentifiable", F.lit(False)
    )
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    no_uncertain = F.coalesce(F.size(result["uncertain_fields"]), F.lit(0)) <= 0
    silent_spec = F.coalesce(
        F.exists(
            result["specifications"],
            lambda s: F.coalesce(s["evidence_level"] == "unconfirmed", F.lit(False))
            & empty(s["value"]),
        ),
        F.lit(False),
    )
    return F.array_compact(
        F.array(
            F.when(unusable != unidentifiable, F.lit("quality_status_mismatch")),
            F.when(unusable & no_uncertain, F.lit("unusable_without_reason")),
            F.when(silent_spec, F.lit("unconfirmed_without_value")),
            F.when(empty(result["confusable_candidate"]), F.lit("no_confusable_candidate")),
        )
    )
