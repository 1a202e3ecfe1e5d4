"""Raw reply bodies to text, and text to VARIANT.

A VARIANT keeps what ``from_json`` blurs: absent, JSON null and wrong type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank_js


def parse_json(text: Column) -> Column:
    """VARIANT, or null when the text as a whole is not one JSON value.

    Spark's own parser stops after the first value and accepts whatever
    follows.  So the text is parsed as the first of two list items, the second
    being its hash: the hash is reached only if nothing else follows.
    """
    return whole_json(json_pair(text), text)


def json_pair(text: Column) -> Column:
    """VARIANT of a list: the text's first JSON value, then the text's hash if nothing else follows."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def whole_json(pair: Column, text: Column) -> Column:
    """The value in a pair of :func:`json_pair`, null unless it is all there is in the text."""
    whole = (field(pair, "$[1]", "string") == F.md5(text)) & field(pair, "$[2]").isNull()
    return F.when(whole, field(pair, "$[0]"))


def parse_status(text: Column, value: Column) -> Column:
    """``empty_reply``, ``bad_json`` or ``ok`` for a text and its parsed value."""
    return (
        F.when(is_blank_js(text), F.lit("empty_reply"))
        .when(value.isNull(), F.lit("bad_json"))
        .otherwise(F.lit("ok"))
    )


def field(value: Column, path: str, kind: str = "variant") -> Column:
    """A field of a VARIANT, null when absent or not castable."""
    return F.try_variant_get(value, path, kind)


def json_kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``VOID`` (JSON null) or a scalar type; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_null_or_absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def first_text_part(body: Column) -> Column:
    """Shape G: text of the first part of the first candidate whose ``text`` is a string."""
    parts = field(body, "$.candidates[0].content.parts", "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: field(p, "$.text")), is_string)
    return F.get(texts, F.lit(0)).cast("string")


def content_items(body: Column) -> Column:
    """Shape R: content items of all output items; a missing or null content adds nothing."""
    items = F.coalesce(field(body, "$.output", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(
        F.transform(
            items,
            lambda i: F.coalesce(
                field(i, "$.content", "array<variant>"), F.array().cast("array<variant>")
            ),
        )
    )


def _is_output_text(item: Column) -> Column:
    kind = field(item, "$.type")
    return is_string(kind) & (kind.cast("string") == "output_text")


def first_output_text(body: Column) -> Column:
    """Shape R: text of the first ``output_text`` item; null unless that text is a string."""
    first = F.get(F.filter(content_items(body), _is_output_text), F.lit(0))
    text = field(first, "$.text")
    return F.when(is_string(text), text.cast("string"))


def all_output_text(body: Column, found: Column | None = None) -> Column:
    """Shape R: every ``output_text`` joined in order without separator.

    ``found`` may hand over ``content_items(body)`` where it is a column already.

    Null when the body breaks the shape: not an object, ``output`` or a
    ``content`` present but not a list, a text present but not a string.
    An absent ``output``, ``content`` or ``text`` counts as empty.
    """
    found = content_items(body) if found is None else found
    output = field(body, "$.output")
    items = field(body, "$.output", "array<variant>")
    texts = F.transform(
        F.filter(found, _is_output_text), lambda i: field(i, "$.text")
    )
    broken = (
        ~is_object(body)
        | (output.isNotNull() & items.isNull())
        | F.coalesce(
            F.exists(
                items,
                lambda i: ~is_object(i)
                | (field(i, "$.content").isNotNull()
                   & field(i, "$.content", "array<variant>").isNull()),
            ),
            F.lit(False),
        )
        | F.exists(found, lambda c: ~is_object(c))
        | F.exists(texts, lambda t: t.isNotNull() & ~is_string(t))
    )
    return F.when(
        ~broken,
        F.array_join(F.transform(texts, lambda t: F.coalesce(t.cast("string"), F.lit(""))), ""),
    )


def reply_text(provider: Column, body: Column) -> Column:
    """The text a provider's body carries: shape G for gemini, shape R for the others."""
    return F.when(provider == "gemini", first_text_part(body)).otherwise(first_output_text(body))


def python_text(value: Column) -> Column:
    """A JSON scalar as Python's ``str(value or '')`` prints it."""
    text = value.cast("string")
    kind = json_kind(value)
    falsy = (
        is_null_or_absent(value)
        | ((kind == "BOOLEAN") & (text == "false"))
        | (kind.isin("BIGINT", "DECIMAL", "DOUBLE") & (text.try_cast("double") == 0))
        | (kind.startswith("ARRAY") & (text == "[]"))
        | (kind.startswith("OBJECT") & (text == "{}"))
    )
    return (
        F.when(falsy, F.lit(""))
        .when(kind == "BOOLEAN", F.lit("True"))
        .otherwise(F.coalesce(text, F.to_json(value)))
    )


def answer_or_empty(response: Column, null_is_empty: bool) -> Column:
    """The ``answer`` object of a reply as ``map<string,variant>``.

    Absent gives an empty map.  With ``null_is_empty`` every falsy value does
    too (gated evaluation); without it a null is an error (isolated one).
    An error is a null map.
    """
    answer = field(response, "$.answer")
    empty = F.create_map().cast("map<string,variant>")
    as_map = field(answer, "$", "map<string,variant>")
    absent = is_object(response) & answer.isNull()
    if null_is_empty:
        absent = is_object(response) & (python_text(answer) == "")
    return F.when(absent, empty).otherwise(as_map)
