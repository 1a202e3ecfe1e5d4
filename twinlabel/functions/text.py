"""String functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    JAVASCRIPT_SPACE,
    NAME_OVERLAP,
    NAME_SEPARATOR,
    PYTHON_SPACE,
)

# Every white space character but the blank, and the two joiners, become a blank.
_TO_BLANK = "-_" + PYTHON_SPACE.replace(" ", "")


def strip(text: Column) -> Column:
    """Trim every Unicode white space character from both ends."""
    return F.btrim(text, F.lit(PYTHON_SPACE))


def is_blank_js(text: Column) -> Column:
    """Null, empty, or nothing but JavaScript white space."""
    return text.isNull() | (F.btrim(text, F.lit(JAVASCRIPT_SPACE)) == "")


def tokens(value: Column) -> Column:
    """Tokens of the lower-cased text in order; ``-`` and ``_`` separate, ``×`` reads as ``x``."""
    plain = F.translate(
        F.lower(F.coalesce(value, F.lit(""))), _TO_BLANK + "×", " " * len(_TO_BLANK) + "x"
    )
    return F.array_remove(F.split(plain, " "), "")


def norm(value: Column) -> Column:
    """Lower case, ``-`` and ``_`` to space, ``×`` to ``x``, white space collapsed."""
    return F.array_join(tokens(value), " ")


def token_set(value: Column) -> Column:
    """Distinct tokens of the normalised text; empty array for an empty text."""
    return F.array_distinct(tokens(value))


def token_intersection(left: Column, right: Column) -> Column:
    return F.array_intersect(left, right)


def category_match(expected: Column, answer: Column) -> Column:
    """Strict equality of the normalised values; a missing answer never matches a value."""
    return norm(expected) == norm(answer)


def token_overlap_match(left: Column, right: Column, threshold: float = NAME_OVERLAP) -> Column:
    """Shared tokens over the smaller set reach the threshold; false if a set is empty."""
    smaller = F.least(F.size(left), F.size(right))
    shared = F.size(token_intersection(left, right))
    return F.coalesce((smaller > 0) & (shared >= smaller * F.lit(threshold)), F.lit(False))


def item_name_match(expected: Column, answer: Column, threshold: float = NAME_OVERLAP) -> Column:
    return token_overlap_match(token_set(expected), token_set(answer), threshold)


def media_type(content_type: Column) -> Column:
    """``Image/PNG; q=1`` -> ``image/png``; missing -> empty string."""
    return F.lower(strip(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def truncate_text(text: Column, chars: int) -> Column:
    """The first ``chars`` code points."""
    return F.substring(text, 1, chars)


def strip_code_fence(text: Column) -> Column:
    """Trimmed text without a leading ``` or ```json fence and a trailing fence."""
    plain = strip(text)
    opened = (
        F.when(F.startswith(plain, F.lit("```json")), F.substr(plain, F.lit(8)))
        .when(F.startswith(plain, F.lit("```")), F.substr(plain, F.lit(4)))
        .otherwise(plain)
    )
    closed = F.when(
        F.endswith(opened, F.lit("```")), F.left(opened, F.length(opened) - 3)
    ).otherwise(opened)
    return strip(closed)


def join_names(names: Column, separator: str = NAME_SEPARATOR) -> Column:
    return F.array_join(names, separator)


def error_text(kind: Column, message: Column) -> Column:
    """``<kind>: <message>``."""
    return F.concat(kind, F.lit(": "), F.coalesce(message, F.lit("")))


def upstream_error(http_status: Column, code: Column, message: Column) -> Column:
    """Error text of a reply outside 200..299, whole; null for a good one.

    A log line may cut it with ``truncate_text``.
    """
    text = F.concat_ws(" ", F.concat(F.lit("HTTP "), http_status.cast("string"), F.lit(":")),
                       F.coalesce(code, F.lit("None")), F.coalesce(message, F.lit("None")))
    return F.when(~http_status.between(200, 299), text)
