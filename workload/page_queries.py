"""Links and image choice over the web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.operators.nested import explode_items
from twinlabel.plans.pages import page_candidates as candidates_of
from twinlabel.plans.pages import resolve_page_images

from .registry import SQL_SPACE, query, table

# The pages hold no pictures, so other path pieces stand for image extensions.
EXTENSIONS = ("/th", "/la", "/de", ".")
ANY_PATH = ("/",)

# The references that occur in the pages, the ampersand last; their semicolon may be missing.
_ENTITIES = (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def _unescaped(expr: str) -> str:
    for name, char in _ENTITIES:
        expr = f"regexp_replace({expr}, '&{name};?', '{char}', 'g')"
    return f"replace({expr}, '\\/', '/')"


_ATTR = ("(?i)(?:src|data-src|data-original|href|content)" + SQL_SPACE + "*=" + SQL_SPACE
         + r"*[\"'']([^\"'']+)[\"'']")
_BARE = r"(?i)https?://[^\"''<>" + SQL_SPACE[1:-1] + "]+"

LINKS_SQL = f"""
  SELECT page_id, url, html_text, list_transform(raw, lambda u:
           CASE WHEN u LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]+') || u
                WHEN regexp_matches(u, '^https?://') THEN u
                ELSE regexp_extract(url, '^https?://[^/?#]+(?:/(?:[^/?#]*/)*)?') || u END) AS links
  FROM (SELECT page_id, url, html_text,
               list_concat(regexp_extract_all(html_text, '{_ATTR}', 1),
                           regexp_extract_all(html_text, '{_BARE}')) AS raw
        FROM (SELECT page_id, url, {_unescaped('html')} AS html_text FROM pages))"""


@query(f"SELECT page_id, md5(html_text) AS text_md5 FROM ({LINKS_SQL})")
def page_text(spark, sf_dir):
    """Entities decoded over the whole page."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(T.page_text(F.col("html"))).alias("text_md5")
    )


@query(f"""
  WITH l AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS i
             FROM ({LINKS_SQL})),
  f AS (SELECT page_id, link, min(i) AS first FROM l
        WHERE contains(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '/')
        GROUP BY page_id, link)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos, link FROM f""")
def page_candidates(spark, sf_dir):
    """Every link with a path, resolved, first occurrences in page order."""
    return (
        candidates_of(table(spark, sf_dir, "pages"), ANY_PATH)
        .transform(explode_items, "candidates", "page_id", value="link")
        .withColumnRenamed("index", "pos")
    )


@query(f"""
  WITH l AS (SELECT page_id, url, list_filter(links, lambda u:
               {' OR '.join(f"contains(lower(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1)), '{e}')"
                            for e in EXTENSIONS)}) AS links
             FROM ({LINKS_SQL})),
  h AS (SELECT page_id, url, links, regexp_extract(url, '^(https?)', 1) AS scheme,
               regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS lang FROM l)
  SELECT page_id,
         CASE WHEN lang = 'de' THEN 'not_html' WHEN lang = 'es' THEN 'ok'
              WHEN len(links) = 0 THEN 'unresolved' ELSE 'ok' END AS image_status,
         CASE WHEN lang = 'es' THEN 'https://img.example/' || page_id WHEN lang = 'de' THEN NULL
              ELSE coalesce(list_filter(links, lambda u: contains(lower(u), 'la'))[1], links[1]) END
           AS image
  FROM h""")
def page_image_choice(spark, sf_dir):
    """One image per page: explicit link, wrong type, hinted link, first link, none."""
    lang = F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1)
    pages = table(spark, sf_dir, "pages").withColumns(
        {
            "content_type": F.when(lang == "de", "application/pdf; v=1")
            .when(lang == "en", "Text/HTML; charset=utf-8"),
            "image_hint": F.lit("LA"),
            "image_url": F.when(lang == "es", F.concat(F.lit("https://img.example/"), "page_id")),
        }
    )
    return resolve_page_images(pages, EXTENSIONS).select("page_id", "image_status", "image")
