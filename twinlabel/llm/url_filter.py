"""URL filtering by rules, and by trust and distrust spread over the links between hosts.

Pages that a rule allows make their hosts trusted seeds, pages that one blocks make them
blocked seeds.  Personalised PageRank carries trust from the trusted seeds along the links;
run over the reversed links it carries distrust from the blocked seeds to whoever links to
them.  A page that no rule fits gets the verdict of its host: blocked if distrust makes up
more than half of what has reached the host.

Links are summed per pair of hosts before they are shuffled, so the graph has a row per
pair and not per link, and a host with a third of all pages is one row of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, clear, pick, scratch_dir, small, written

# (host, start of path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
ROUNDS = 12
ROUNDS_PER_TABLE = 4
# Share of distrust in what reached a host, above which its pages are blocked.
THRESHOLD = 0.5


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(
        ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit("")
    )


def path_of(url: Column) -> Column:
    return F.coalesce(
        F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit("")
    )


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``ruled``, the longest rule that fits host and path and its verdict.

    Of equally long ones the one with the longer host counts, then block.  Rules are a
    list in the program, so each page looks through them in an expression.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))

    def first(value) -> Column:
        chosen = None
        for rule in order:
            host, path, _ = rule
            at = (F.col("host") == host) | F.col("host").endswith("." + host)
            fits = at & F.col("path").startswith(path)
            chosen = F.when(fits, value(rule)) if chosen is None else chosen.when(fits, value(rule))
        return F.lit(None).cast("string") if chosen is None else chosen

    return pages.withColumns(
        {"rule": first(lambda r: r[0] + r[1]), "ruled": first(lambda r: r[2])}
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, weight): links between hosts; a relative link stays on its host."""
    href = F.split(F.coalesce(F.col("html"), F.lit("")), r"""(?i)href\s*=\s*["']?""", -1)
    targets = F.transform(
        F.slice(href, 2, F.size(href)), lambda part: F.regexp_extract(part, r"""^[^"'\s>]*""", 0)
    )
    link = F.trim("link")
    target = (
        F.when(link.rlike("^(?i)https?://"), host_of(F.col("link")))
        .when(link.startswith("//"), host_of(F.concat(F.lit("http:"), link)))
        .when(~link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("host"))
    )
    return (
        pages.select("host", F.explode(targets).alias("link"))
        .select(F.col("host").alias("source"), target.alias("target"))
        .where((F.col("target") != "") & (F.col("source") != ""))
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host, seed), along source to
    target.  A host without links keeps what it has, as if it linked to itself.

    A round is a join of the scores with the links and a sum per target, combined before
    the shuffle.  Every few rounds the scores become a table that replaces the last one.
    """
    spark = links.sparkSession
    out = Window.partitionBy("source")
    linked = links.select(
        "source", "target", (F.col("weight") / F.sum("weight").over(out)).alias("share")
    )
    hosts = links.select(F.col("target").alias("source")).union(seeds.select("host")).distinct()
    ends = hosts.join(links.select("source").distinct(), "source", "left_anti")
    steps = written(
        linked.unionByName(
            ends.select("source", F.col("source").alias("target"), F.lit(1.0).alias("share"))
        ),
        "link-shares",
    )
    start = written(
        seeds.where(F.col("seed") > 0).select("host", F.col("seed").alias("score")), "seeds"
    )
    again = start.select("host", ((1 - DAMPING) * F.col("score")).alias("score"))
    scores, path = start, None
    for step in range(1, rounds + 1):
        moved = scores.join(small(steps), F.col("host") == F.col("source")).select(
            F.col("target").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score")
        )
        scores = moved.unionByName(again).groupBy("host").agg(F.sum("score").alias("score"))
        if step % ROUNDS_PER_TABLE == 0 or step == rounds:
            old, path = path, scratch_dir(spark, "scores")
            scores = written(scores, "scores", path)
            if old:
                clear(spark, old)
    return scores


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = ROUNDS
) -> DataFrame:
    """Per page: host, path, rule, verdict, and the trust and distrust of its host.

    Host and path are empty for a url that is null or has no ``://``; such a page, and one
    whose host nothing has reached, is allowed unless a rule fits.  A null html has no
    links.  Repeated rows get equal results; an empty table gives no rows.
    """
    read = pick(pages, "page_id", "url", "html").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"
    )
    ruled = written(with_rule(read.drop("html"), rules), "ruled-pages")
    seeds = written(
        ruled.where(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("allowed"),
            F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("blocked"),
        ),
        "seed-hosts",
    )
    links = written(host_links(read), "host-links")
    back = links.select(
        F.col("target").alias("source"), F.col("source").alias("target"), "weight"
    )
    trust = propagate(links, seeds.select("host", F.col("allowed").alias("seed")), rounds)
    distrust = propagate(back, seeds.select("host", F.col("blocked").alias("seed")), rounds)
    hosts = written(
        trust.withColumnRenamed("score", "trust").join(
            distrust.withColumnRenamed("score", "distrust"), "host", "full"
        ).na.fill(0.0),
        "host-scores",
    )
    blocked = F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust"))
    by_host = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    return ruled.join(small(hosts), "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
