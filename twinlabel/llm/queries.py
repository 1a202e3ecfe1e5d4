"""The dealt operators bound to the driver's tables, with SQL where it can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .byte_bpe import round_trip
from .decontamination import contamination
from .exact_dedup import exact_duplicates
from .language_id import languages
from .merkle import FAN_OUT, audited
from .mixing import mixed
from .passages import shared_passages
from .repeat_removal import without_repeats
from .simhash_dedup import near_duplicates
from .spelling import DAMAGE, MIN_COUNT, MIN_LENGTH, RATIO, spelling_variants
from .toxicity import toxicity
from .url_filter import DAMPING, ROUNDS, RULES, THRESHOLD, judged
from .warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL_LOWER = (
    "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

ORACLE["op3_exact_dedup"] = f"""
  WITH n AS (SELECT doc_id, {SQL_LOWER.format("coalesce(text, '')")} AS t FROM documents)
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
         sha256(t) AS text_sha256
  FROM n WINDOW w AS (PARTITION BY t)"""


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


_SQL_WORDS = (
    r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
).format(SQL_LOWER.format("coalesce(text, '')"))

ORACLE["op7_benchmark_decontamination"] = f"""
  WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
  ph AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
               FROM b WHERE len(w) > 0)),
  st AS (SELECT doc_id, s, k.n, array_to_string(w[s:s + k.n - 1], ' ') AS p
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d)
         JOIN (SELECT DISTINCT n FROM ph) k ON s + k.n - 1 <= len(w)),
  m AS (SELECT doc_id, s, st.n, item FROM st JOIN ph USING (n, p)),
  h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
  i AS (SELECT doc_id, count(DISTINCT item) AS n_items,
               string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_pagerank(name: str, source: str, target: str, seed: str) -> str:
    """CTEs ``{name}0`` to ``{name}{ROUNDS}``: scores after each round."""
    steps = f"""
  {name}s AS (SELECT {source} AS source, {target} AS target,
                     weight / sum(weight) OVER (PARTITION BY {source}) AS share FROM links
              UNION ALL SELECT host, host, 1.0
              FROM (SELECT {target} AS host FROM links UNION SELECT host FROM hosts)
              WHERE host NOT IN (SELECT {source} FROM links)),
  {name}0 AS (SELECT host, {seed} AS score FROM hosts WHERE {seed} > 0)"""
    for i in range(ROUNDS):
        steps += f""",
  {name}{i + 1} AS (SELECT host, sum(score) AS score FROM (
    SELECT target AS host, {DAMPING} * score * share AS score
    FROM {name}{i} JOIN {name}s ON host = source
    UNION ALL SELECT host, (1 - {DAMPING}) * score FROM {name}0) GROUP BY host)"""
    return steps


def _sql_rules() -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    return " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') "
        f"THEN '{host}{path} {verdict}'"
        for host, path, verdict in longest
    )


_SQL_HOST = SQL_LOWER.format(r"regexp_extract({}, '^[^/?#]*')")

ORACLE["op10_url_filter"] = rf"""
  WITH u AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0
               THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, html, {_SQL_HOST.format("rest")} AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  r AS (SELECT *, CASE {_sql_rules()} END AS hit FROM p),
  hosts AS (SELECT host, count(*) FILTER (hit LIKE '% allow') AS allowed,
                   count(*) FILTER (hit LIKE '% block') AS blocked
            FROM r WHERE host <> '' GROUP BY host),
  l AS (SELECT host AS source, unnest(regexp_extract_all(
          coalesce(html, ''), '(?i)href\s*=\s*["'']?([^"''\s>]*)', 1)) AS link FROM p),
  t AS (SELECT source, CASE WHEN regexp_matches(link, '^(?i)https?://')
                 THEN {_SQL_HOST.format("substr(link, position('://' IN link) + 3)")}
               WHEN starts_with(link, '//') THEN {_SQL_HOST.format("substr(link, 3)")}
               WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN source END AS target
        FROM l),
  links AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM t
            WHERE source <> '' AND target <> '' GROUP BY ALL),
  {_sql_pagerank("t", "source", "target", "allowed")},
  {_sql_pagerank("d", "target", "source", "blocked")}
  SELECT page_id, r.host, path, split_part(hit, ' ', 1) AS rule,
         CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 2)
              WHEN coalesce(d.score, 0) > {THRESHOLD} * (coalesce(d.score, 0) + coalesce(t.score, 0))
              THEN 'block' ELSE 'allow' END AS verdict
  FROM r LEFT JOIN t{ROUNDS} t ON t.host = r.host LEFT JOIN d{ROUNDS} d ON d.host = r.host"""


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and link trust over the urls of all pages."""
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal fingerprints over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return languages(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that long repeated strings cover."""
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLE["op4_warc"] = """
  WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  f AS (SELECT html, min(page_id) AS least FROM p GROUP BY html)
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
         CASE WHEN strlen(html) >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END
           AS record_type,
         CASE WHEN strlen(html) >= 100 AND page_id <> least THEN least END AS refers_to
  FROM p JOIN f USING (html)"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back through the capture index."""
    return archived(table(spark, sf_dir, "pages"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all documents in a mix of their sources."""
    return mixed(table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share."""
    return shared_passages(table(spark, sf_dir, "documents"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to tokens and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"))


# crc32 of a list of bytes, over the table of all single bytes in the relation ``crc``.
_SQL_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t)"""


def _sql_crc(text: str) -> str:
    bytes_of = (
        f"list_transform(range(strlen({text})), "
        f"lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    )
    return (
        f"xor(list_reduce({bytes_of}, "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


def _sql_framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _sql_tree(name: str, levels: int) -> str:
    """CTEs above ``{name}0`` (tree, i, c, h): ``{name}{k}`` holds the nodes of level k, and
    ``{name}s{k}`` the siblings on either side of each."""
    steps = []
    for k in range(levels):
        steps.append(f"""
  {name}{k + 1} AS (SELECT tree, i // {FAN_OUT} AS i, any_value((c + 7) // {FAN_OUT}) AS c,
      CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
    FROM {name}{k} AS n GROUP BY tree, n.i // {FAN_OUT}),
  {name}s{k} AS (SELECT tree, i, c, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED
      PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1
      FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k} WINDOW w AS (PARTITION BY tree, i // {FAN_OUT} ORDER BY i))""")
    return ",".join(steps)


def _sql_folds(name: str, start: str, levels: int) -> str:
    """CTEs ``{start}1`` to ``{start}{levels}``: rows (tree, i, cur, proof) folded level by level."""
    return ",".join(
        f"""
  {start}{k + 1} AS (SELECT f.* REPLACE (f.i // {FAN_OUT} AS i,
      CASE WHEN c > 1 THEN sha256(l || cur || r) ELSE cur END AS cur,
      CASE WHEN c > 1 THEN proof || l || r ELSE proof END AS proof)
    FROM {start}{k} f JOIN {name}s{k} s ON f.tree IS NOT DISTINCT FROM s.tree AND f.i = s.i)"""
        for k in range(levels)
    )


# Levels of the trees in SQL: enough for 2 million leaves and 512 languages.
_SQL_LEAVES, _SQL_TREES = 7, 3
_SQL_HEAD = " || ".join(_sql_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE["op11_merkle_manifest"] = f"""
  WITH {_SQL_CRC_TABLE},
  d AS (SELECT doc_id, lang AS tree, sha256({_SQL_HEAD} || {_sql_framed("text")}) AS h,
               sha256({_SQL_HEAD} || {_sql_framed(SQL_LOWER.format("text"))}) AS tampered,
               {_sql_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit FROM documents, crc),
  o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
               count(*) OVER (PARTITION BY tree) AS c FROM d),
  n0 AS (SELECT tree, i, c, h FROM o),{_sql_tree("n", _SQL_LEAVES)},
  u0 AS (SELECT 0 AS tree, n.tree AS lang, row_number() OVER (ORDER BY n.tree NULLS FIRST) - 1 AS i,
                count(*) OVER () AS c, h FROM n{_SQL_LEAVES} n),{_sql_tree("u", _SQL_TREES)},
  f0 AS (SELECT doc_id, tree, h AS leaf, i, '' AS proof,
                CASE WHEN hit THEN tampered ELSE h END AS cur FROM o),
  {_sql_folds("n", "f", _SQL_LEAVES)},
  g0 AS (SELECT f.doc_id, f.leaf, u.h AS subroot, u.tree, u.i, f.cur, f.proof
         FROM f{_SQL_LEAVES} f JOIN u0 u ON f.tree IS NOT DISTINCT FROM u.lang),
  {_sql_folds("u", "g", _SQL_TREES)}
  SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
         cur = h AS verified
  FROM g{_SQL_TREES}, u{_SQL_TREES}"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against the root of their manifest."""
    return audited(table(spark, sf_dir, "documents"))


# Words that agree where one code point of each is blanked differ by a replacement; a word that
# equals another without one of its code points differs by an insertion.
ORACLE["op13_spelling_variants"] = rf"""
  WITH RECURSIVE {_SQL_CRC_TABLE},
  r AS (SELECT doc_id, run, count(*) AS k
        FROM (SELECT doc_id, unnest(regexp_extract_all({SQL_LOWER.format("text")},
                '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
  m AS (SELECT run, k, {_sql_crc("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM r, crc),
  v AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:]
               ELSE run END AS word, k FROM m),
  w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= {MIN_LENGTH}
        GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
  x AS (SELECT word, word[:i] AS l, word[i + 2:] AS r
        FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
  p AS (SELECT a.word, b.word AS near FROM x a JOIN x b USING (l, r) WHERE a.word <> b.word),
  e AS (SELECT x.word, w.word AS near FROM x JOIN w ON w.word = l || r),
  q AS (SELECT DISTINCT word, near FROM (FROM p UNION ALL FROM e UNION ALL SELECT near, word FROM e)),
  b AS (SELECT q.word, count(*) AS n_near, max(w.n) AS top,
               arg_min(near, (-w.n, near)) AS best FROM q JOIN w ON w.word = near GROUP BY q.word),
  f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN best END AS form,
               CASE WHEN top >= {RATIO} * n THEN top END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
  c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at
        WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
  FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.at WHERE g.form IS NULL"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents grouped by spelling variants."""
    return spelling_variants(table(spark, sf_dir, "documents"))
