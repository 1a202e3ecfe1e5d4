"""Grouping of spelling variants by a relational trie frontier.

The words of the corpus form two tries, one over the words and one over the words spelled
backwards, each kept as a distributed table of edges.  A node is a prefix at which words part
or end; an edge carries the code points between two nodes.  The frontier holds states (word,
target, place, node, edits) and moves down one edge a level: it is joined with the edges of
that depth only, so each edge is used once.  A state without an edit follows its word; at a
node it may also leave out the next code point, or replace it by that of another edge.  From
then on the state follows the edited word, its target, and if that ends where a word ends,
the two are neighbours.

Two words that differ by one edit agree in one half of the longer one at least.  The forward
trie takes edits in the second half of a word and the backward trie those in the first, so a
state branches only below a shared half, where few words are left.  Insertions are the
deletions of the other word, and of two words that replace a code point one finds the other;
pairs are turned around at the end.

Nodes are 64-bit hashes of prefixes.  A clash can add a path but never hides one, and every
target is held against the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, scratch_dir, written

MIN_LENGTH = 5
MIN_COUNT = 3
# One run in so many loses a code point.
DAMAGE = 97
RUN = r"[a-zÀ-ÿ]"
# The least ratio of counts between a form and its variant.
RATIO = 2

# Prefixes up to this length are nodes in any case.  All words share few of them, so they would
# be hot keys of the join that finds the nodes.
_SHALLOW = 4
# Edges of one depth go to all tasks up to these bounds; hot nodes are shallow, and shallow
# depths have few edges.
_EDGES, _EDGE_BYTES = 100_000, 4_000_000
# Words of at most so many bytes are their own key, longer ones have a digest as theirs.
_KEY_BYTES = 32


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of all texts and their number of occurrences ``n``.

    A word is a maximal run of letters, lower-cased in A-Z only; where ``DAMAGE`` divides the
    crc32 of ``<doc_id>:<run>``, the run's code point at that number modulo its length is left
    out.  A null id counts as empty there.
    """
    # A shorter run gives a shorter word still, so it need not leave its text.
    runs = F.regexp_extract_all(
        ascii_lower(F.col("text")), F.lit(f"({RUN}{{{min_length},}})"), F.lit(1)
    )
    run = F.col("run")
    mark = F.crc32(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary")
    )
    at = (F.col("mark") % F.length(run)).cast("int")
    damaged = F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))
    return (
        pick(docs, "doc_id", "text")
        .select("doc_id", F.explode(runs).alias("run"))
        .withColumn("mark", mark)
        .select(F.when(F.col("mark") % DAMAGE == 0, damaged).otherwise(run).alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def _key(word: Column) -> Column:
    raw = word.cast("binary")
    return F.when(F.octet_length(word) <= _KEY_BYTES, raw).otherwise(F.unhex(F.sha2(raw, 256)))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, pos, node, next) of every prefix of every word, forwards (side 0) and
    backwards (side 1); ``next`` is the code point that follows, -1 at the end.

    A prefix hashes to the sum of a mix of each place and its code point.
    """
    for batch in batches:
        keys = batch.column("key")
        texts = batch.column("word").to_pylist()
        start = 0
        while start < len(texts):
            stop, points = start, 0
            while stop < len(texts) and (stop == start or points + len(texts[stop]) <= 500_000):
                points += len(texts[stop])
                stop += 1
            sizes = np.array([len(t) for t in texts[start:stop]])
            for side in (0, 1):
                part = [t[::-1] if side else t for t in texts[start:stop]]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), dtype="<u4")
                ends = np.cumsum(sizes)
                begins = ends - sizes
                pos = np.arange(points) - np.repeat(begins, sizes)
                mixed = _mixed(
                    codes.astype(np.uint64)
                    + (pos.astype(np.uint64) * np.uint64(4) + np.uint64(1 + side) << np.uint64(22))
                )
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
                # One more row than code points for each word.
                word = np.repeat(np.arange(len(part)), sizes + 1)
                place = np.arange(points + len(part)) - np.repeat(begins + np.arange(len(part)), sizes + 1)
                at = begins[word] + place
                node = total[at] - total[begins[word]]
                following = np.where(
                    place < sizes[word], np.append(codes, 0)[at].astype(np.int64), -1
                )
                yield pa.record_batch(
                    [
                        keys.take(pa.array(word + start)),
                        pa.array(np.full(len(word), side, dtype=np.int8)),
                        pa.array(place.astype(np.int32)),
                        pa.array(node.view(np.int64)),
                        pa.array(following.astype(np.int32)),
                    ],
                    names=["key", "side", "pos", "node", "next"],
                )
            start = stop


def _spelled(word: Column, side: Column) -> Column:
    return F.when(side == 0, word).otherwise(F.reverse(word))


def trie(words: DataFrame) -> DataFrame:
    """Edges (depth, side, node, first, label, child, ends) of both tries; ``ends`` says whether a
    word ends at the child."""
    keyed = words.select(_key(F.col("word")).alias("key"), "word")
    prefixes = written(
        keyed.mapInArrow(_prefixes, "key binary, side byte, pos int, node long, next int"),
        "prefixes",
    )
    always = (F.col("pos") <= _SHALLOW) | (F.col("next") == -1)
    parting = (
        prefixes.where(F.col("pos") > _SHALLOW)
        .groupBy("side", "node")
        .agg(F.min("next").alias("_least"), F.max("next").alias("_most"))
        .where("_least <> _most")
        .select("side", "node")
    )
    nodes = prefixes.where(always).unionByName(
        prefixes.where(~always).join(parting, ["side", "node"], "left_semi")
    )
    paths = nodes.groupBy("key", "side").agg(
        F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("path")
    )
    here, there = F.col("path")[F.col("depth")], F.col("path")[F.col("depth") + 1]
    edges = (
        paths.join(keyed, "key")
        .withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("path") - 2)))
        .select(
            "depth",
            "side",
            here["node"].alias("node"),
            F.substring(
                _spelled(F.col("word"), F.col("side")), here["pos"] + 1, there["pos"] - here["pos"]
            ).alias("label"),
            there["node"].alias("child"),
            (F.col("depth") == F.size("path") - 2).alias("ends"),
        )
        .groupBy("depth", "side", "node", "label", "child")
        .agg(F.max("ends").alias("ends"))
        .withColumn("first", F.substring("label", 1, 1))
    )
    # Files of one depth can be told by their statistics.
    return written(edges.repartitionByRange("depth", "node").sortWithinPartitions("depth"), "trie")


def _sent(edges: DataFrame) -> DataFrame:
    """The edges of a depth, marked for broadcast if they are few and short."""
    size = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("label")).alias("bytes")
    ).first()
    few = size["n"] <= _EDGES and (size["bytes"] or 0) <= _EDGE_BYTES
    return F.broadcast(edges) if few else edges


def _moved(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states of the next depth, among them those that have found a neighbour."""
    state = ["word", "side", "target", "pos", "node", "edits", "ends"]
    length = F.length("word")
    # The edits of the forward trie are those in the second half of the word.
    half = F.when(F.col("side") == 0, F.floor(length / 2)).otherwise(length - F.floor(length / 2))
    open_to_edit = (F.col("edits") == 0) & (F.col("pos") >= half) & (F.col("pos") < length)
    cur = F.substring("target", F.col("pos") + 1, F.lit(1))
    following = F.substring("target", F.col("pos") + 2, F.lit(1))
    head = F.substring("target", F.lit(1), F.col("pos"))
    tail = F.substr(F.col("target"), F.col("pos") + 2)
    shorter = frontier.where(open_to_edit & (cur != following)).select(
        "word", "side", F.concat(head, tail).alias("target"), "pos", "node",
        F.lit(1).alias("edits"), "ends",
    )
    reads = frontier.unionByName(shorter)
    rest = F.substring("target", F.col("pos") + 1, F.length("label"))
    onward = (
        reads.where(F.col("pos") < F.length("target"))
        .withColumn("first", cur)
        .drop("ends")
        .join(edges, ["side", "node", "first"])
    )
    replaced = (
        frontier.where(open_to_edit)
        .drop("ends")
        .join(edges, ["side", "node"])
        .where(F.col("first") > cur)
        .withColumn("target", F.concat(head, F.col("first"), tail))
        .withColumn("edits", F.lit(1))
    )
    moved = (
        onward.unionByName(replaced)
        .where(F.col("label") == rest)
        .select(
            "word", "side", "target",
            (F.col("pos") + F.length("label")).alias("pos"),
            F.col("child").alias("node"), "edits", "ends",
        )
    )
    # A deletion of the last code point may end at the node where it began.
    ended = shorter.where(F.col("ends") & (F.col("pos") == F.length("target")))
    there = F.col("pos") == F.length("target")
    return (
        moved.unionByName(ended.select(*state))
        .withColumn("found", (F.col("edits") == 1) & there & F.col("ends"))
        .where("found OR pos < length(target)")
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, near) of ``words`` that differ by exactly one inserted, deleted or replaced
    code point, each pair in both directions."""
    edges = trie(words)
    frontier = words.select(
        "word",
        F.explode(F.array(F.lit(0).cast("byte"), F.lit(1).cast("byte"))).alias("side"),
    ).select(
        "word", "side", _spelled(F.col("word"), F.col("side")).alias("target"),
        F.lit(0).alias("pos"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("edits"),
        F.lit(False).alias("ends"),
    )
    spark, depth, tables = words.sparkSession, 0, []
    folder = scratch_dir(spark, "frontier")
    while not frontier.isEmpty():
        path = f"{folder}/{depth}"
        moved = written(
            _moved(frontier, _sent(edges.where(F.col("depth") == depth).drop("depth"))), "frontier", path
        )
        tables.append(path)
        frontier, depth = moved.where("NOT found").drop("found"), depth + 1
    if not tables:
        return words.select("word", F.col("word").alias("near")).limit(0)
    pairs = (
        spark.read.schema(moved.schema).parquet(*tables)
        .where("found")
        .select("word", _spelled(F.col("target"), F.col("side")).alias("near"))
        .distinct()
        .join(words.select(F.col("word").alias("near")), "near", "left_semi")
    )
    return pairs.select("word", "near").union(pairs.select("near", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``, the end of the chain of forms.  Each round
    doubles the part of a chain that is known; counts double along a chain, so it is short."""
    chain = written(forms.select("word", F.coalesce("form", "word").alias("root")), "chain")
    while True:
        onward = chain.select(F.col("word").alias("_at"), F.col("root").alias("_onward"))
        longer = written(
            chain.join(onward, F.col("root") == F.col("_at")).select(
                "word",
                F.col("_onward").alias("root"),
                (F.col("root") != F.col("_onward")).alias("moved"),
            ),
            "chain",
        )
        still = longer.where("moved").isEmpty()
        chain = longer.drop("moved")
        if still:
            return forms.join(chain, "word")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near and form_n.

    The form is the near word of largest n (of equals the smallest in code point order), if
    it occurs at least ``ratio`` times as often as the word; else null.  The root is reached by
    following forms; a word without a form is its own.
    """
    near = near_pairs(words).join(
        words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"
    )
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"),
    )
    fits = -F.col("_best.less") >= ratio * F.col("n")
    forms = written(
        words.join(best, "word", "left").select(
            "word",
            F.when(fits, F.col("_best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, -F.col("_best.less")).alias("form_n"),
        ),
        "forms",
    )
    return _roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all texts with their forms and roots, see :func:`words` and
    :func:`variants`.

    Null, empty and letterless texts have no words; rows that repeat count each time; a word
    may be of any length.  An empty table gives no rows.  Columns other than doc_id and text
    are not looked at, whatever their names.
    """
    return variants(written(words(docs), "words"))
