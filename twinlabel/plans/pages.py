"""Image resolution from landed web pages: one projection chain, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import IMAGE_EXTENSIONS
from ..functions.images import page_acceptance
from ..functions.text import media_type
from ..functions.urls import (
    absolutise_all,
    first_candidate,
    hint_filter,
    html_unescape,
    image_url_filter,
    og_image,
    page_text,
    raw_candidates,
)
from ..operators.folds import distinct_candidates
from ..operators.nested import pin


def page_links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """Add ``links`` (every link resolved, in order, null where it cannot be) and ``og``."""
    found = pages.transform(pin, _text=page_text(F.col(html))).transform(
        pin, _raw=raw_candidates(F.col("_text")), _og=og_image(F.col("_text"))
    )
    # The preview image rides along as the last element: one resolution per page.
    wanted = F.concat("_raw", F.array(html_unescape(F.col("_og"))))
    resolved = found.transform(pin, _wanted=wanted).transform(
        pin, _all=absolutise_all(F.col(base), F.col("_wanted"))
    )
    return resolved.withColumns(
        {
            "links": F.slice("_all", F.lit(1), F.size("_raw")),
            "og": F.when(F.col("_og").isNotNull(), F.element_at("_all", -1)),
        }
    ).drop("_text", "_raw", "_og", "_wanted", "_all")


def page_candidates(pages: DataFrame, extensions=IMAGE_EXTENSIONS, html: str = "html",
                    base: str = "url") -> DataFrame:
    """Add ``candidates``: image links of the page, first occurrences in order."""
    known = F.filter("links", lambda u: u.isNotNull())
    return page_links(pages, html, base).transform(
        pin, candidates=distinct_candidates(image_url_filter(known, extensions))
    )


def resolve_page_images(pages: DataFrame, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Choose one image link per page.

    ``pages``: url, html and optionally content_type, image_hint, image_url.
    An explicit ``image_url`` wins and such a page is not parsed at all.  Adds
    ``image`` and ``image_status`` (ok, not_html, bad_link, unresolved).
    """
    for name in ("content_type", "image_hint", "image_url"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    explicit = F.coalesce(F.col("image_url"), F.lit("")) != ""
    accepted = page_acceptance(media_type(F.col("content_type")))
    # Null text for rows that need no parsing keeps them out of every later step.
    parsed = page_candidates(
        pages.withColumn("_page", accepted).withColumn(
            "_html", F.when(~explicit & (F.col("_page") == "ok"), F.col("html"))
        ),
        extensions,
        html="_html",
    )
    chosen = first_candidate(
        hint_filter(F.col("candidates"), F.col("image_hint")), F.col("og"), F.col("candidates")
    )
    bad_link = F.coalesce(F.exists("links", lambda u: u.isNull()), F.lit(False))
    status = (
        F.when(explicit, F.lit("ok"))
        .when(F.col("_page") != "ok", F.col("_page"))
        .when(bad_link, F.lit("bad_link"))
        .when(chosen.isNull(), F.lit("unresolved"))
        .otherwise(F.lit("ok"))
    )
    return (
        parsed.withColumn("image_status", status)
        .withColumn(
            "image",
            F.when(explicit, F.col("image_url")).when(F.col("image_status") == "ok", chosen),
        )
        .drop("_page", "_html", "links", "og")
    )
