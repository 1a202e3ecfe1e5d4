"""Format, size and acceptance rules of image files."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_EDGE_PX, MIME_BY_FORMAT, MIN_EDGE_PX


def target_size(width: Column, height: Column, edge: int = MAX_EDGE_PX) -> Column:
    """Both edges scaled so that neither passes ``edge``; never enlarged, rounded half up."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / width, F.lit(float(edge)) / height)
    return F.struct(
        F.floor(width * scale + 0.5).cast("int").alias("width"),
        F.floor(height * scale + 0.5).cast("int").alias("height"),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def file_format(content: Column) -> Column:
    """Format by the leading bytes; null when none is known."""
    return _once(F.hex(F.substring(content, 1, 12)), _format)


def _format(head: Column) -> Column:
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "GIF")
        .when(head.startswith("52494646") & head.endswith("57454250"), "WEBP")
        .when(head.startswith("424D"), "BMP")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
        .when(F.substring(head, 9, 16) == "6674797061766966", "AVIF")
    )


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """Unsigned number of ``size`` bytes from the 0-based place ``at``; null past the end."""
    start = F.lit(at) if isinstance(at, int) else at
    code = F.hex(F.substring(content, start + 1, F.lit(size)))
    if little:
        whole = F.concat(*[F.substring(code, 2 * i + 1, 2) for i in reversed(range(size))])
    else:
        whole = code
    return F.when(F.length(code) == 2 * size, F.conv(whole, 16, 10).cast("long"))


def _edges(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


# The last chunk of a PNG, and JPEG markers that carry the size (start of frame)
# and that stand alone, without a length.
PNG_END = "0000000049454E44AE426082"
JPEG_FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
JPEG_ALONE = (0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7)
JPEG_SCAN, JPEG_END, JPEG_FILL = 0xDA, 0xD9, 0xFF

# Segments before the frame that a first walk looks at; files have a few, colour profiles some more.
_SEGMENTS = 48


def _jpeg_walk(content: Column, steps: Column) -> Column:
    """Hop from marker to marker until the frame header; ``at`` is null once the walk is over."""
    kind = "struct<at: int, width: int, height: int>"

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        none = F.lit(None).cast("int")

        def follow(marker: Column) -> Column:
            hop = F.when(marker == JPEG_FILL, 1).when(marker.isin(*JPEG_ALONE), 2).otherwise(
                2 + _number(content, at + 2, 2)
            )
            over = (_number(content, at, 1) != 0xFF) | marker.isin(JPEG_SCAN, JPEG_END)
            found = F.struct(
                none.alias("at"),
                _number(content, at + 7, 2).cast("int").alias("width"),
                _number(content, at + 5, 2).cast("int").alias("height"),
            )
            onward = F.struct(
                F.when(~over, at + hop.cast("int")).alias("at"), none.alias("width"), none.alias("height")
            )
            return F.when(marker.isin(*JPEG_FRAMES), found).otherwise(onward).cast(kind)

        return F.when(at.isNull(), state).otherwise(_once(_number(content, at + 1, 1), follow))

    start = F.struct(
        F.lit(2).alias("at"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
    ).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), steps), start, step)


def _jpeg_size(content: Column) -> Column:
    # A segment has four bytes at least.
    whole = _jpeg_walk(content, F.greatest(F.lit(1), (F.length(content) / 4).cast("int")))
    walked = _once(
        _jpeg_walk(content, F.lit(_SEGMENTS)), lambda first: F.when(first["at"].isNull(), first).otherwise(whole)
    )
    return _once(walked, lambda state: _edges(state["width"], state["height"]))


def image_size(content: Column) -> Column:
    """(width, height) from the header of a PNG, JPEG, GIF, BMP or WebP file; no pixel is decoded.

    Null edges where there is no such header, and for a PNG whose header fails its check sum or
    that ends before its last chunk.
    """
    header = F.substring(content, F.lit(13), F.lit(17))
    whole = (F.crc32(header) == _number(content, 29, 4)) & F.contains(
        content, F.unhex(F.lit(PNG_END))
    )
    png = F.when(whole, _edges(_number(content, 16, 4), _number(content, 20, 4)))
    gif = _edges(_number(content, 6, 2, True), _number(content, 8, 2, True))
    # The height of a bitmap is negative if its rows run downwards.
    rows = _number(content, 22, 4, True)
    bmp = _edges(_number(content, 18, 4, True), F.when(rows >= 2**31, 2**32 - rows).otherwise(rows))
    chunk = F.hex(F.substring(content, F.lit(13), F.lit(4)))
    packed = _number(content, 21, 4, True)
    webp = (
        F.when(chunk == "56503858", _edges(_number(content, 24, 3, True) + 1, _number(content, 27, 3, True) + 1))
        .when(chunk == "5650384C", _edges(packed % 2**14 + 1, F.floor(packed / 2**14) % 2**14 + 1))
        .when(chunk == "56503820", _edges(_number(content, 26, 2, True) % 2**14, _number(content, 28, 2, True) % 2**14))
    )
    size = _once(
        file_format(content),
        lambda fmt: F.when(fmt == "PNG", png)
        .when(fmt == "JPEG", _jpeg_size(content))
        .when(fmt == "GIF", gif)
        .when(fmt == "BMP", bmp)
        .when(fmt == "WEBP", webp),
    )
    return F.get(F.filter(F.array(size), lambda s: (s["width"] > 0) & (s["height"] > 0)), F.lit(0))


def mime_of(image_format: Column) -> Column:
    """MIME of a format the models accept; null means it needs conversion."""
    table = F.create_map(*[F.lit(x) for x in chain(*MIME_BY_FORMAT.items())])
    return F.try_element_at(table, image_format)


def needs_conversion(image_format: Column) -> Column:
    return mime_of(image_format).isNull()


def final_format(image_format: Column) -> Column:
    return F.when(needs_conversion(image_format), F.lit("JPEG")).otherwise(image_format)


def final_mime(image_format: Column) -> Column:
    return F.coalesce(mime_of(image_format), F.lit(MIME_BY_FORMAT["JPEG"]))


def image_acceptance(
    length: Column, width: Column, height: Column, content_type: Column, min_edge: int = MIN_EDGE_PX
) -> Column:
    """Reason code of the first failed check, else ``ok``.

    ``width`` is null or negative for a file that does not decode;
    ``content_type`` is already reduced to its media type.
    """
    kind = F.coalesce(content_type, F.lit(""))
    return (
        F.when(F.coalesce(length, F.lit(0)) == 0, F.lit("empty_body"))
        .when(F.coalesce(width, F.lit(-1)) < 0, F.lit("undecodable"))
        .when((width < min_edge) | (height < min_edge), F.lit("too_small"))
        .when((kind != "") & ~F.startswith(kind, F.lit("image/")), F.lit("not_an_image"))
        .otherwise(F.lit("ok"))
    )


def acceptance_detail(reason: Column, width: Column, height: Column, content_type: Column) -> Column:
    """The value a failed check complains about."""
    return F.when(
        reason == "too_small", F.concat_ws("x", width.cast("string"), height.cast("string"))
    ).when(reason == "not_an_image", content_type)


def page_acceptance(content_type: Column) -> Column:
    """``not_html`` for a declared type without ``html``; an empty type passes."""
    kind = F.coalesce(content_type, F.lit(""))
    return F.when((kind != "") & ~F.contains(kind, F.lit("html")), F.lit("not_html")).otherwise(
        F.lit("ok")
    )
