"""Words, their character n-grams as hashed features, and tables of word values.

Shared by the models that read text word by word.  All work on lists of words is done on
whole arrays of code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
# Word characters of the regular expression engine that are neither letters nor decimal
# digits, such as fractions and letter numbers; they separate words.
_NUMERALS = {
    c: " "
    for c in range(0x110000)
    if chr(c).isnumeric() and not chr(c).isalpha() and not chr(c).isdecimal()
}
_NUMERAL_CHARS = frozenset(map(chr, _NUMERALS))

# Characters of text whose words are held at once, and words whose values are remembered.
BLOCK_CHARS = 300_000
TABLE_WORDS = 80_000

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    if not text.isascii() and not _NUMERAL_CHARS.isdisjoint(text):
        text = text.translate(_NUMERALS)
    return WORD.findall(text.lower())


def incidence(vocabulary: list[str], sizes: Iterable[int], buckets: int):
    """(feature, word) index pairs: the n-grams of each word with its ends marked, hashed
    into buckets."""
    marked = "".join(f"<{word}>" for word in vocabulary)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(
        np.arange(len(vocabulary)), np.fromiter((len(w) + 2 for w in vocabulary), int, len(vocabulary))
    )
    features, owners = [], []
    for n in sizes:
        if len(points) < n:
            continue
        value = np.full(len(points) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            value = (value ^ points[i : len(points) - n + 1 + i]) * _PRIME
        inside = owner[: len(value)] == owner[n - 1 :]
        value = (value[inside] * _MIX) >> np.uint64(33)
        features.append((value % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(inside)][inside])
    if not features:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feature, word = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(word, kind="stable")
    return feature[order], word[order]


def summed(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` per owner; owners ascend."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.searchsorted(owner, np.arange(size + 1))
    return total[ends[1:]] - total[ends[:-1]]


def bags(values: np.ndarray, feature: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Sums of the features' rows of ``values`` per owner, some owners at a time."""
    out = np.empty((size, values.shape[1]))
    for at in range(0, size, 8192):
        low, high = np.searchsorted(owner, [at, min(at + 8192, size)])
        out[at : at + 8192] = summed(
            values[feature[low:high]], owner[low:high] - at, min(8192, size - at)
        )
    return out


class WordTable:
    """Values per word, computed once for as many words as are remembered."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int):
        self._compute, self._width = compute, width
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._values = np.zeros((0, self._width))

    def values(self, tokens: list[str]) -> np.ndarray:
        if len(self._row) > TABLE_WORDS:
            self._forget()
        row = self._row
        fresh = list(dict.fromkeys(tokens).keys() - row.keys())
        if fresh:
            row.update(zip(fresh, range(len(row), len(row) + len(fresh))))
            self._values = np.concatenate([self._values, self._compute(fresh)])
        return self._values[np.fromiter((row[w] for w in tokens), np.int64, len(tokens))]


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, words per text) of a few texts at a time, so that the words held at once are
    bounded by the block or by one text."""
    tokens: list[str] = []
    counts: list[int] = []
    chars = 0
    for text in texts:
        found = words(text)
        tokens += found
        counts.append(len(found))
        chars += len(text or "")
        if chars > BLOCK_CHARS:
            yield tokens, np.array(counts)
            tokens, counts, chars = [], [], 0
    if counts:
        yield tokens, np.array(counts)
