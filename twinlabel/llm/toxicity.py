"""Toxicity of a text from subword-bag embeddings.

A word is the bag of its character n-grams with its ends marked; every hashed n-gram has a
vector.  The vectors of the words in a stretch of text are averaged and go into a linear
softmax; vectors and softmax are trained together in numpy.  A misspelling that was never
seen shares most n-grams with the word it comes from.

A few words may make a long text toxic, so a text scores as the worst of its stretches,
which overlap and cover all of it, and training lets the worst stretch of a text answer
for its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pick, small, written
from .subwords import WordTable, bags, blocks, incidence, summed, words

# Bounds of the sample: labelled rows per class, and characters of a text in it.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 3000

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 16
DIMENSIONS = 8
STRETCH_WORDS = 5
EPOCHS = 30
# Epochs in which whole texts are averaged, before their worst stretches are.
WHOLE_EPOCHS = 8
TOXIC_FROM = 0.7


@dataclass
class Model:
    """N-gram values along the line the softmax looks at, and its bias.

    Averaging and the softmax's inputs are linear, so a vector per n-gram is not needed
    any more once training is done.
    """

    values: np.ndarray
    bias: float

    def word_values(self, vocabulary: list[str]) -> np.ndarray:
        """Summed value and number of the n-grams of each word."""
        feature, word = incidence(vocabulary, NGRAMS, BUCKETS)
        value = bags(self.values[:, None], feature, word, len(vocabulary))
        return np.column_stack([value, np.bincount(word, minlength=len(vocabulary))])


def _starts(counts: np.ndarray):
    """First word of every stretch: each half a stretch further, up to the end of a text."""
    step = STRETCH_WORDS // 2
    number = np.maximum(1, -(-(counts - STRETCH_WORDS) // step) + 1)
    number = np.where(counts > 0, number, 0)
    owner = np.repeat(np.arange(len(counts)), number)
    first = np.concatenate([[0], np.cumsum(number)])[:-1]
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    start = begin[owner] + (np.arange(len(owner)) - first[owner]) * step
    end = np.minimum(start + STRETCH_WORDS, (begin + counts)[owner])
    return owner, start, end


def _stretch_logits(pairs: np.ndarray, start: np.ndarray, end: np.ndarray, bias: float):
    total = np.concatenate([np.zeros((1, 2)), np.cumsum(pairs, axis=0)])
    value, number = (total[end] - total[start]).T
    return value / np.maximum(number, 1) + bias


def _worst(logits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Index of the stretch with the largest logit of each owner that has one."""
    order = np.lexsort((logits, owner))
    return order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(order) else order


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """A model of the texts; without texts of both classes it scores all alike."""
    labels = np.array(toxic, dtype=np.float64)
    prior = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    split = [words(text) for text in texts]
    tokens = [w for found in split for w in found]
    if not tokens or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    draw = np.random.default_rng(seed)
    vocabulary = list(dict.fromkeys(tokens))
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = np.fromiter((place[w] for w in tokens), np.int64, len(tokens))
    feature, word = incidence(vocabulary, NGRAMS, BUCKETS)
    number = np.bincount(word, minlength=len(vocabulary)).astype(np.float64)
    counts = np.array([len(found) for found in split])
    begin = np.concatenate([[0], np.cumsum(counts)])
    owner, start, end = _starts(counts)
    vectors = draw.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    softmax = np.zeros((DIMENSIONS, 2))
    softmax[:, 1] = draw.normal(0, 1, DIMENSIONS)
    bias = np.zeros(2)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-8), np.full_like(softmax, 1e-8), np.full(2, 1e-8)
    # Both classes weigh the same at first, so that the rare one is learned at all.
    for epoch in range(EPOCHS):
        of_word = bags(vectors, feature, word, len(vocabulary))
        if epoch < WHOLE_EPOCHS:
            text = np.flatnonzero(counts > 0)
            low, high = begin[text], begin[text + 1]
        else:
            line = softmax[:, 1] - softmax[:, 0]
            pairs = np.stack([of_word @ line, number], axis=1)[ids]
            chosen = _worst(_stretch_logits(pairs, start, end, 0.0), owner)
            text, low, high = owner[chosen], start[chosen], end[chosen]
        inside = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
        of = np.repeat(np.arange(len(text)), high - low)
        grams = np.maximum(np.bincount(of, number[ids[inside]], len(text)), 1)
        mean = summed(of_word[ids[inside]], of, len(text)) / grams[:, None]
        logit = mean @ softmax + bias
        chance = np.exp(logit - logit.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        truth = np.stack([1 - labels[text], labels[text]], axis=1)
        weight = np.where(labels[text] == 1, 0.5 / max(labels[text].mean(), 1e-9), 0.5 / max(1 - labels[text].mean(), 1e-9))
        slope = (chance - truth) * weight[:, None] / len(text)
        to_mean = slope @ softmax.T / grams[:, None]
        to_word = np.zeros_like(of_word)
        np.add.at(to_word, ids[inside], to_mean[of])
        touched = np.zeros(len(vocabulary), dtype=bool)
        touched[ids[inside]] = True
        use = np.flatnonzero(touched[word])
        down = np.zeros_like(vectors)
        for at in range(0, len(use), 1 << 18):
            part = use[at : at + (1 << 18)]
            np.add.at(down, feature[part], to_word[word[part]])
        seen_v += (down**2).mean(1)
        vectors -= 2.0 * down / np.sqrt(seen_v)[:, None]
        turn = mean.T @ slope
        seen_s += turn**2
        softmax -= 0.1 * turn / np.sqrt(seen_s)
        tilt = slope.sum(0)
        seen_b += tilt**2
        bias -= 0.1 * tilt / np.sqrt(seen_b)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS):
    """Texts and toxic marks of at most ``rows`` documents of each class that may be learned
    from, drawn by a hash of the id, with texts of at most ``chars`` characters.

    Labels are drawn first, so only few texts are looked up.
    """
    marked = pick(labels, "doc_id", "toxic").where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    texts, toxic = [], []
    for value in (0, 1):
        drawn = marked.where(F.col("toxic") == value).orderBy(*order).limit(2 * rows)
        found = (
            pick(docs, "doc_id", "text")
            .where(F.length("text") <= chars)
            .join(small(written(drawn, "toxicity-sample")), "doc_id")
            .orderBy(*order, "text")
            .limit(rows)
            .select("text")
            .take(rows)
        )
        texts += [r["text"] for r in found]
        toxic += [value] * len(found)
    return texts, toxic


def scorer(model: Model):
    """A column function from a text to its score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = WordTable(model.word_values, 2)
        for texts in batches:
            logit = np.full(len(texts), model.bias)
            start = 0
            for tokens, counts in blocks(texts):
                if tokens:
                    owner, low, high = _starts(counts)
                    each = _stretch_logits(table.values(tokens), low, high, model.bias)
                    worst = _worst(each, owner)
                    logit[start + owner[worst]] = each[worst]
                start += len(counts)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -50, 50))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted.

    Learned from labels of documents that are not held out.  A text that is null or has no
    word gets the score of an average of nothing, the softmax's bias.  Labels that are null
    or neither 0 nor 1 are passed over; without labels of both classes all texts score
    alike.  Repeated rows get equal results; an empty table gives no rows.
    """
    score = scorer(fit(*training_rows(docs, labels)))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
