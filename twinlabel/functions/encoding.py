"""Bytes, base64 and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_PAYLOAD_CHARS, PAYLOAD_PATTERN


def base64_line(content: Column) -> Column:
    """Base64 as one unbroken line (Spark breaks the line every 76 characters)."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def data_url(mime: Column, payload: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), payload)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def byte_length(content: Column) -> Column:
    return F.octet_length(content)


def decode_utf8_replace(content: Column) -> Column:
    """Bytes to text; malformed sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def valid_payload(image: Column, limit: int = MAX_PAYLOAD_CHARS) -> Column:
    """Non-empty, at most ``limit`` characters, and plain base64 alphabet throughout."""
    text = F.coalesce(image, F.lit(""))
    return F.length(text).between(1, limit) & text.rlike(PAYLOAD_PATTERN)
