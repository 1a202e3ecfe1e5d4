"""Language of a text by a linear-chain conditional random field over its words.

Each word gets a label.  Its features are hashed character n-grams with the ends of the
word marked (those at an end are its affixes) and, for words that are frequent in the
training texts, the word itself.  Transitions between labels are learned.  Training texts
hold one language each, so pieces of them are strung together into code-switched
sequences.  Forward-backward gives the probability of each label at each word; a text's
language is the label with the largest sum over all of its words.

The model is fitted in numpy on a bounded sample of labelled rows; every text is scored
whole, in a pandas function that Spark runs where the rows are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drawn, held_out, pick, unpack
from .subwords import WordTable, bags, blocks, incidence, words

# Bounds of the sample: rows per fit, and characters of a text that may take part.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 6000

NGRAMS = (2, 3, 4)
BUCKETS = 1 << 15
LEXICON = 4000
PIECE_WORDS = 8
CHAIN_WORDS = 48
EPOCHS = 25
UNDETERMINED = "und"
# The pipeline rejects a text whose words, each for itself, are less certain of a language.
MIN_CERTAINTY = 0.4


@dataclass
class Field:
    """A fitted model: labels, weights per feature, lexicon and transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    transition: np.ndarray

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        feature, word = _features(vocabulary, self.lexicon)
        return bags(self.weights, feature, word, len(vocabulary))


def _features(vocabulary: list[str], lexicon: dict[str, int]):
    feature, word = incidence(vocabulary, NGRAMS, BUCKETS)
    known = [(BUCKETS + lexicon[w], i) for i, w in enumerate(vocabulary) if w in lexicon]
    if known:
        extra = np.array(known, dtype=np.int64)
        feature, word = np.concatenate([feature, extra[:, 0]]), np.concatenate([word, extra[:, 1]])
        order = np.argsort(word, kind="stable")
        feature, word = feature[order], word[order]
    return feature, word


def forward_backward(emission: np.ndarray, real: np.ndarray, transition: np.ndarray):
    """Label probabilities per position of each chain, and expected transitions.

    ``emission`` is (chains, positions, labels); positions that are not ``real`` pad the end.
    """
    chains, length, labels = emission.shape
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    step = np.exp(transition)
    ahead = np.empty_like(local)
    ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        now = (ahead[:, t - 1] @ step) * local[:, t]
        ahead[:, t] = now / now.sum(1, keepdims=True)
    behind = np.ones((chains, labels))
    result = np.empty_like(local)
    moves = np.zeros((labels, labels))
    for t in range(length - 1, -1, -1):
        both = ahead[:, t] * behind
        result[:, t] = both / both.sum(1, keepdims=True)
        if t:
            seen = real[:, t]
            right = local[:, t] * behind
            joint = ahead[seen, t - 1][:, :, None] * step[None] * right[seen][:, None, :]
            moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            before = right @ step.T
            before /= before.sum(1, keepdims=True)
            behind = np.where(seen[:, None], before, 1.0)
    return result, moves


def _chains(counts: np.ndarray, size: int):
    """Cuts texts into chains of at most ``size`` words: position of each word, owner and
    length of each chain."""
    per_text = -(-counts // size)
    owner = np.repeat(np.arange(len(counts)), per_text)
    first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    nth = np.arange(len(owner)) - first[owner]
    length = np.minimum(counts[owner] - nth * size, size)
    return owner, length


def _padded(rows: np.ndarray, length: np.ndarray, size: int):
    real = np.arange(size)[None, :] < length[:, None]
    out = np.zeros((len(length), size, *rows.shape[1:]), dtype=rows.dtype)
    out[real] = rows
    return out, real


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Field | None:
    """A field for the languages of the texts, or None if no text has a word."""
    draw = np.random.default_rng(seed)
    pieces, labels = [], sorted(set(langs))
    number = {lang: i for i, lang in enumerate(labels)}
    for text, lang in zip(texts, langs):
        found = words(text)
        pieces += [
            (found[i : i + PIECE_WORDS], number[lang]) for i in range(0, len(found), PIECE_WORDS)
        ]
    if not pieces:
        return None
    pieces = [pieces[i] for i in draw.permutation(len(pieces))]
    tokens = [w for piece, _ in pieces for w in piece]
    gold = np.repeat([label for _, label in pieces], [len(piece) for piece, _ in pieces])
    frequent = Counter(tokens).most_common(LEXICON)
    lexicon = {w: i for i, (w, n) in enumerate(frequent) if n > 1}
    vocabulary = list(dict.fromkeys(tokens))
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = np.fromiter((place[w] for w in tokens), np.int64, len(tokens))
    feature, word = _features(vocabulary, lexicon)
    size = len(labels)
    _, length = _chains(np.array([len(tokens)]), 4 * PIECE_WORDS)
    chain_ids, real = _padded(ids, length, 4 * PIECE_WORDS)
    chain_gold, _ = _padded(gold, length, 4 * PIECE_WORDS)
    observed = np.zeros((size, size))
    np.add.at(observed, (chain_gold[:, :-1][real[:, 1:]], chain_gold[:, 1:][real[:, 1:]]), 1)
    weights = np.zeros((BUCKETS + LEXICON, size))
    transition = np.zeros((size, size))
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    for _ in range(EPOCHS):
        emission = bags(weights, feature, word, len(vocabulary))
        slope = np.zeros((len(vocabulary), size))
        moves = np.zeros_like(transition)
        for at in range(0, len(chain_ids), 4096):
            part, inside = chain_ids[at : at + 4096], real[at : at + 4096]
            chance, moved = forward_backward(emission[part], inside, transition)
            chance[np.arange(len(part))[:, None], np.arange(part.shape[1])[None], chain_gold[at : at + 4096]] -= 1
            for k in range(size):
                slope[:, k] += np.bincount(part[inside], chance[..., k][inside], len(vocabulary))
            moves += moved
        down = np.stack(
            [np.bincount(feature, slope[word, k], len(weights)) for k in range(size)], axis=1
        )
        down = down / len(tokens) + 1e-7 * weights
        seen_w += down**2
        weights -= 0.3 * down / np.sqrt(seen_w)
        turn = (moves - observed) / len(tokens) + 1e-4 * transition
        seen_t += turn**2
        transition -= 0.2 * turn / np.sqrt(seen_t)
    return Field(labels, weights.astype(np.float32), lexicon, transition)


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list, list]:
    """Texts and languages of at most ``rows`` labelled documents that may be learned from,
    drawn by a hash of the id among texts of at most ``chars`` characters."""
    labelled = pick(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= chars)
    )
    sample = drawn(labelled, rows, "doc_id", "text", "lang").select("text", "lang").take(rows)
    return [r["text"] for r in sample], [r["lang"] for r in sample]


def predictor(field: Field | None):
    """A column function from a text to (lang, score, certain): the likeliest language, its share
    of the words, and the mean chance of each word's own likeliest language."""

    @F.pandas_udf("lang string, score double, certain double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = WordTable(field.emissions, len(field.labels)) if field else None
        for texts in batches:
            lang = np.full(len(texts), UNDETERMINED, dtype=object)
            score, certain = np.zeros(len(texts)), np.zeros(len(texts))
            start = 0
            for tokens, counts in blocks(texts):
                here = slice(start, start + len(counts))
                start += len(counts)
                if not tokens or field is None:
                    continue
                owner, length = _chains(counts, CHAIN_WORDS)
                emission, real = _padded(table.values(tokens), length, CHAIN_WORDS)
                chance, _ = forward_backward(emission, real, field.transition)
                chance[~real] = 0
                total = np.zeros((len(counts), len(field.labels)))
                np.add.at(total, owner, chance.sum(1))
                best = total.argmax(1)
                own = np.zeros(len(counts))
                np.add.at(own, owner, chance.max(2).sum(1))
                has = counts > 0
                certain[here] = np.clip(own / np.maximum(counts, 1), 0, 1)
                lang[here] = np.where(has, np.array(field.labels, dtype=object)[best], UNDETERMINED)
                score[here] = np.where(
                    has, np.clip(total[np.arange(len(best)), best] / np.maximum(counts, 1), 0, 1), 0.0
                )
            yield pd.DataFrame({"lang": lang, "score": score, "certain": certain})

    return predict


def languages(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred and score, the mean certainty of its words.

    ``und`` with score 0 for a text that is null or has no letter, and for all texts if
    there is nothing to learn from.  Learned from text and lang of rows that are not held
    out.  Repeated rows get equal results; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    predict = predictor(fit(*training_rows(docs)))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")
    )
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def in_some_language(docs: DataFrame, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """The rows of ``docs`` whose words are in some language with at least ``min_certainty`` on
    average.  A text in several languages stays if each of its words is told."""
    bounded_batches(docs.sparkSession)
    predict = predictor(fit(*training_rows(docs)))
    rows = pick(docs, "text", carry=True).withColumn("p", predict("text"))
    certain: Column = (F.col("p.lang") != UNDETERMINED) & (F.col("p.certain") >= min_certainty)
    return unpack(rows.where(certain), docs.columns)
