"""Benchmark contamination through a distributed positional inverted index.

Texts are cut into words once and kept as a table.  Counting the test terms over the whole
corpus tells which terms of each test phrase are rarest; the postings (term, row,
position) of those terms are the stored index.  Shifted by their offset inside the phrase,
the postings of one occurrence meet at the same start, so phrases are found by
intersecting the shifted lists of their rarest terms, and the few starts that remain are
compared word by word.  Nothing but expressions and joins is used.

Postings of one term are plain rows, dealt by row and start, so a term that stands in
every text does not gather in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick, small, unpack, with_row_key, written

# Everything in ASCII but digits and lower-case letters separates words.
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINDOW_WORDS = 10
# Terms of a phrase whose postings are intersected.
RAREST_TERMS = 2


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lower, _SEPARATOR), "")


def tokenised(docs: DataFrame) -> DataFrame:
    """The words of every document row, as a table."""
    rows = with_row_key(pick(docs, "doc_id", "text"))
    words = rows.select("doc_id", "_key", "_hash", words_of("text").alias("words"))
    return written(words.withColumn("n_words", F.size("words").cast("long")), "words")


def phrases_of(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, phrase, n) for each window of ``size`` words; a shorter item is one phrase.

    Words hold no space, so a phrase is its words joined by one.
    """
    words = pick(items, "item_id", "text").select("item_id", words_of("text").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        words.where(F.size("w") > 0)
        .select("item_id", "w", F.explode(starts).alias("i"))
        .select("item_id", F.slice("w", F.col("i"), size).alias("w"))
        .select("item_id", F.concat_ws(" ", "w").alias("phrase"), F.size("w").alias("n"))
        .distinct()
    )


def rarest_terms(tokens: DataFrame, phrases: DataFrame, terms: int = RAREST_TERMS) -> DataFrame:
    """(phrase, n, term, offset, place): the terms of each phrase with the fewest
    occurrences in the whole corpus.  A phrase with a term the corpus lacks is left out:
    it occurs nowhere."""
    places = phrases.select("phrase", "n").distinct().select(
        "phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term")
    )
    vocabulary = written(places.select("term").distinct(), "test-terms")
    counts = (
        tokens.select(F.explode("words").alias("term"))
        .join(small(vocabulary), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    # A word that stands in most phrases would gather them all in a shuffled join.
    counts = small(written(counts, "term-counts"))
    phrase = Window.partitionBy("phrase")
    ranked = places.join(counts, "term", "left").withColumns(
        {
            "missing": F.max(F.col("frequency").isNull()).over(phrase),
            "place": F.row_number().over(phrase.orderBy("frequency", "offset")) - 1,
        }
    )
    return written(
        ranked.where(~F.col("missing") & (F.col("place") < terms)).select(
            "phrase", "n", "term", "offset", "place"
        ),
        "rarest-terms",
    )


def postings(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """The stored index: (term, _key, _hash, position) of every occurrence of the terms."""
    terms = written(anchors.select("term").distinct(), "index-terms")
    occurrences = tokens.select("_key", "_hash", F.posexplode("words").alias("position", "term"))
    return written(occurrences.join(small(terms), "term"), "postings")


def _shifted(index: DataFrame, anchors: DataFrame) -> DataFrame:
    return index.join(small(anchors), "term").withColumn(
        "start", F.col("position") - F.col("offset")
    )


def exact_matches(tokens: DataFrame, index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(_key, _hash, phrase, start, n): every place where a phrase stands word for word."""
    meeting = (
        _shifted(index, anchors)
        .where(F.col("start") >= 0)
        .groupBy("_key", "_hash", "phrase", "n", "start")
        .agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("seen"))
        .where(F.col("seen") == F.expr(f"shiftleft(1, least(n, {RAREST_TERMS})) - 1"))
        .drop("seen")
    )
    candidates = written(meeting, "phrase-candidates")
    rows = written(candidates.select("_key", "_hash").distinct(), "candidate-rows")
    texts = (
        tokens.join(small(rows), ["_key", "_hash"], "left_semi")
        .select("_key", "_hash", "words")
        .dropDuplicates(["_key", "_hash"])
    )
    here = F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("n")))
    return (
        candidates.join(texts, ["_key", "_hash"])
        .where(here == F.col("phrase"))
        .select("_key", "_hash", "phrase", "start", "n")
    )


def proximity_matches(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """(_key, _hash, phrase, start): places where the rarest terms of a phrase stand with up
    to ``slack`` words more or fewer between them than in the phrase."""
    row, shifted = ["_key", "_hash", "phrase"], _shifted(index, anchors)
    found = shifted.where(F.col("place") == 0).select(*row, "n", "start")
    for place in range(1, RAREST_TERMS):
        # Starts at most ``slack`` apart lie in the same or in adjoining stretches of text.
        stretch = F.floor(F.col("start") / (slack + 1))
        other = shifted.where(F.col("place") == place).select(
            *row,
            F.col("start").alias("other"),
            F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"),
        )
        near = (
            found.withColumn("stretch", stretch)
            .join(other, [*row, "stretch"])
            .where(F.abs(F.col("start") - F.col("other")) <= slack)
            .select(*row, "n", "start")
            .distinct()
        )
        found = near.unionByName(found.where(F.col("n") <= place))
    return found.select(*row, "start")


def _hit_words(matches: DataFrame) -> DataFrame:
    """(_key, _hash, n_hit): words inside any match, each counted once."""
    row = ["_key", "_hash"]
    spans = matches.groupBy(*row, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy(*row).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    return (
        spans.withColumn("new", F.greatest(F.col("end") - covered, F.lit(0)))
        .groupBy(*row)
        .agg(F.sum("new").cast("long").alias("n_hit"))
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated.

    A null text has no words; an item without words is in no document.  Items are told
    apart by their id as a string; one with a null id hits words but is not counted.
    Rows that repeat a document get equal results.  Empty tables give no rows, or
    documents without hits.
    """
    tokens = tokenised(docs)
    phrases = written(phrases_of(items), "test-phrases")
    anchors = rarest_terms(tokens, phrases)
    index = postings(tokens, anchors)
    matches = written(exact_matches(tokens, index, anchors), "phrase-matches")
    named = (
        matches.select("_key", "_hash", "phrase")
        .distinct()
        .join(small(phrases.select("phrase", F.col("item_id").cast("string").alias("item"))), "phrase")
        .groupBy("_key", "_hash")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = _hit_words(matches).join(named, ["_key", "_hash"])
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return tokens.select("doc_id", "_key", "_hash", "n_words").join(
        found, ["_key", "_hash"], "left"
    ).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no word lies inside a phrase of ``items``."""
    tokens = tokenised(docs)
    anchors = rarest_terms(tokens, written(phrases_of(items), "test-phrases"))
    matches = exact_matches(tokens, postings(tokens, anchors), anchors)
    hit = written(matches.select("_key", "_hash").distinct(), "contaminated-rows")
    rows = with_row_key(pick(docs, "doc_id", "text", carry=True))
    return unpack(rows.join(small(hit), ["_key", "_hash"], "left_anti"), docs.columns)
