"""Links in HTML: extraction, resolution, filtering.

Two steps need the standard library (entity decoding and general link
resolution).  Both run as Arrow pandas UDFs and are handed nulls for the rows
whose value native expressions can settle, so plain pages never reach Python.
"""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..constants import ATTR_NAMES, IMAGE_EXTENSIONS, PYTHON_SPACE
from .text import strip

_SPACE = "".join(rf"\x{{{ord(c):x}}}" for c in PYTHON_SPACE)

# What counts as a link in a page.
_ATTR_PATTERN = (
    r"(?iu)(?:" + "|".join(ATTR_NAMES) + rf")[{_SPACE}]*=[{_SPACE}]*[\"']([^\"']+)[\"']"
)
_BARE_PATTERN = rf"(?iu)https?://[^\"'<>{_SPACE}]+"
_OG_PROPERTY_FIRST = (
    rf"(?iu)<meta[^>]+property=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)[\"']"
)
_OG_CONTENT_FIRST = (
    rf"(?iu)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:image[\"']"
)

# Links whose resolution is plain: a complete http(s) link, or a root-relative
# path, without dot segments and made of characters that resolution leaves
# alone.  An empty query or fragment would be dropped, so neither matches.
_PLAIN_CHARS = r"\p{L}\p{N}\-_~!$&*+,:=@%()."
_TAIL = rf"(?:\?[{_PLAIN_CHARS}/?]++)?(?:#[{_PLAIN_CHARS}/?]++)?\z"
_ORIGIN = r"https?://[A-Za-z0-9.\-]+(?::[0-9]+)?"
_PLAIN_BASE = rf"\A{_ORIGIN}(?=[/?#]|\z)"
_PLAIN_LINK = rf"\A(?:/(?!/)[{_PLAIN_CHARS}/]*+|{_ORIGIN}(?:/[{_PLAIN_CHARS}/]*+)?){_TAIL}"
_DOT_SEGMENT = r"/\.{1,2}(?:[/?#]|\z)"


# Characters of pages that are Python texts at a time.
_UNESCAPE_BYTES = 1 << 22


@F.arrow_udf(StringType())
def _unescape_udf(texts: pa.Array) -> pa.Array:
    """Page by page: beside the batch only a few are held as Python texts."""
    parts, held, size = [], [], 0
    for text in texts:
        page = text.as_py()
        held.append(None if page is None else html.unescape(page))
        size += len(page or "")
        if size > _UNESCAPE_BYTES:
            parts.append(pa.array(held, pa.string()))
            held, size = [], 0
    parts.append(pa.array(held, pa.string()))
    return pa.concat_arrays(parts)


def html_unescape(text: Column) -> Column:
    """Decode character references; texts without ``&`` skip Python."""
    needs = F.contains(text, F.lit("&"))
    return F.when(needs, _unescape_udf(F.when(needs, text))).otherwise(text)


def page_text(content: Column) -> Column:
    """Entities decoded and ``\\/`` turned into ``/``."""
    return F.replace(html_unescape(content), F.lit("\\/"), F.lit("/"))


def _join(base: str, url: str) -> str | None:
    try:
        return urljoin(base, url)
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def _absolutise_udf(base: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series(
        [None if us is None else [_join(b, u) for u in us] for b, us in zip(base, urls)],
        dtype=object,
    )


def absolutise_all(base: Column, urls: Column) -> Column:
    """Resolve each link of an array against ``base``; an unresolvable one is null.

    Arrays holding plain links only are resolved natively.
    """
    plain_base = base.rlike(_PLAIN_BASE)
    plain = F.coalesce(
        plain_base
        & F.forall(urls, lambda u: u.rlike(_PLAIN_LINK) & ~u.rlike(_DOT_SEGMENT)),
        F.lit(False),
    )
    origin = F.regexp_extract(base, _PLAIN_BASE, 0)
    native = F.transform(
        urls, lambda u: F.when(F.startswith(u, F.lit("/")), F.concat(origin, u)).otherwise(u)
    )
    return F.when(plain, native).otherwise(
        _absolutise_udf(F.when(~plain, base), F.when(~plain, urls))
    )


def absolutise(base: Column, url: Column) -> Column:
    return F.get(absolutise_all(base, F.array(url)), F.lit(0))


def attr_values(text: Column) -> Column:
    """Quoted values of link-carrying attributes, in page order."""
    return F.regexp_extract_all(text, F.lit(_ATTR_PATTERN), F.lit(1))


def bare_urls(text: Column) -> Column:
    """http(s) links anywhere in the text, up to a quote, angle bracket or white space."""
    return F.regexp_extract_all(text, F.lit(_BARE_PATTERN), F.lit(0))


def raw_candidates(text: Column) -> Column:
    """All attribute values, then all bare links; trimmed, empties dropped."""
    found = F.concat(attr_values(text), bare_urls(text))
    return F.filter(F.transform(found, strip), lambda u: u != "")


def url_path_lower(url: Column) -> Column:
    """Lower-cased path: no scheme, host, query or fragment, no ``;`` parameters on its end."""
    url = F.translate(url, "\t\r\n", "")
    path = F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    has_params = url.rlike(
        r"(?i)\A(?:(?:https?|ftp|sftp|shttp|hdl|prospero|rtsps?|sips?|mms|tel):|[^:/?#]*(?:[/?#]|\z))"
    )
    return F.lower(F.when(has_params, F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path))


def has_image_extension(url: Column, extensions=IMAGE_EXTENSIONS) -> Column:
    """The path contains one of the extensions anywhere, not just at its end."""
    path = url_path_lower(url)
    hits = [F.contains(path, F.lit(e)) for e in extensions]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return found


def image_url_filter(urls: Column, extensions=IMAGE_EXTENSIONS) -> Column:
    return F.filter(urls, lambda u: has_image_extension(u, extensions))


def hint_filter(urls: Column, hint: Column) -> Column:
    """Links containing the hint, ignoring case; empty array without a hint."""
    wanted = F.lower(F.coalesce(hint, F.lit("")))
    return F.filter(urls, lambda u: (wanted != "") & F.contains(F.lower(u), wanted))


def og_image(text: Column) -> Column:
    """The page's declared preview image, property before content or the other way round."""
    first = F.regexp_extract(text, _OG_PROPERTY_FIRST, 1)
    second = F.regexp_extract(text, _OG_CONTENT_FIRST, 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def first_candidate(hinted: Column, og: Column, candidates: Column) -> Column:
    """First hinted link, else the preview image, else the first link, else null."""
    return F.coalesce(F.get(hinted, F.lit(0)), og, F.get(candidates, F.lit(0)))
