"""Seeds, collinear chains and alignment of word sequences, on arrays of word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by blocks of that width."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    up_to = np.minimum.accumulate(table, axis=1).ravel()
    down_to = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(down_to[:count], up_to[width - 1 : width - 1 + count])


def seeds(words: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the k-mers of ``size`` words that are the least of some ``window``
    k-mers in a row; any ``size + window - 1`` equal words in a row share one."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        value = (value ^ words[i : len(words) - size + 1 + i]) * _A
        value ^= value >> np.uint64(32)
    value *= _B
    width = min(window, len(value))
    if width < 2:
        return value, np.arange(len(value))
    least = sliding_min(value, width)
    # A k-mer is chosen if it equals the minimum of a window that holds it; the windows that
    # hold k-mer i start at i - width + 1 to i.
    highest = np.iinfo(np.uint64).max - sliding_min(
        np.iinfo(np.uint64).max - np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]),
        width,
    )
    place = np.flatnonzero(value == highest[: len(value)])
    return value[place], place


def stretches(words: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the words from ``start`` up to each of ``ends``, of 32 bits."""
    # Sums of words weighted by powers of an odd number, which has an inverse.
    powers = np.cumprod(np.full(len(words), _A), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(words * powers, dtype=np.uint64))
    back = np.cumprod(np.full(len(words) + 1, np.uint64(pow(int(_A), -1, 1 << 64))), dtype=np.uint64)
    out = []
    for end in ends:
        value = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _B
        value = (value ^ (value >> np.uint64(31))) * _B
        out.append((value >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return out


class Contexts:
    """Stretches of words around one seed, compared by their runs of ``sure`` equal words.

    An alignment goes on only where so many words agree, so each word it matches lies in a run that
    both stretches hold.  ``words`` has a row of 32-bit hashes per stretch, 0 where there is no word.
    """

    def __init__(self, words: np.ndarray, sure: int = 3) -> None:
        self.words, self.sure = words, sure
        count = words.shape[1] - sure + 1
        value, self.whole = np.zeros((len(words), count), np.uint64), np.ones((len(words), count), bool)
        for s in range(sure):
            value = (value ^ words[:, s : s + count]) * _A
            value ^= value >> np.uint64(29)
            self.whole &= words[:, s : s + count] != 0
        # Runs by number; the last number is none.
        place = self.whole.nonzero()
        self.kinds, number = np.unique((value * _B >> np.uint64(32))[place], return_inverse=True)
        self.runs = np.full(self.whole.shape, len(self.kinds))
        self.runs[place] = number

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """The words that lie in the runs ``hit``."""
        out = np.zeros((len(hit), hit.shape[1] + self.sure - 1), bool)
        for s in range(self.sure):
            out[:, s : s + hit.shape[1]] |= hit
        return out

    def close(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Whether ``least`` words of the second row of a pair lie in runs that the first holds;
        equal rows of ``a`` come one after the other."""
        found, held = np.zeros(len(a), bool), np.zeros(len(self.kinds) + 1, bool)
        ends = np.flatnonzero(np.append(a[1:] != a[:-1], True))[: len(a)] + 1
        start = 0
        for end in ends.tolist():
            mine = self.runs[a[start]][self.whole[a[start]]]
            held[mine] = True
            for at in range(start, end, 4096):
                hit = held[self.runs[b[at : min(end, at + 4096)]]]
                maybe = np.flatnonzero(np.count_nonzero(hit, axis=1) * self.sure >= least)
                if len(maybe):
                    found[at + maybe] = np.count_nonzero(self.covered(hit[maybe]), axis=1) >= least
            held[mine] = False
            start = end
        return found

    def pairs(self, few: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first rows, second rows, class per row) of all pairs that may align in ``least`` words.

        Pairs with a run in common that at most ``few`` rows hold are found by that run.  Of all
        other pairs only frequent runs can match, so rows with the same frequent runs in the same
        places are one class (-1 if these have too few words), and classes are held against each
        other by their first rows.
        """
        row, place = np.nonzero(self.whole)
        number, row = np.divmod(np.unique(self.runs[row, place] * len(self.words) + row), max(1, len(self.words)))
        rows = np.bincount(number, minlength=len(self.kinds) + 1)
        rare = rows[number] <= few
        codes = [np.zeros(0, np.int64)]
        r, n = row[rare], number[rare]
        for step in range(1, few):
            both = np.flatnonzero(n[step:] == n[:-step])
            codes.append(np.unique(r[both] * len(self.words) + r[both + step]))
        code = np.unique(np.concatenate(codes))
        one, two = code // len(self.words), code % len(self.words)
        near = self.close(one, two, least)
        ones, twos = [one[near]], [two[near]]

        frequent = (rows > few)[self.runs]
        kept = np.where(self.covered(frequent), self.words, np.uint32(0))
        classes = np.full(len(self.words), -1)
        long = np.flatnonzero((kept != 0).sum(1) >= least)
        if len(long):
            _, first, classes[long] = np.unique(kept[long], axis=0, return_index=True, return_inverse=True)
            alike = Contexts(kept[long[first]], self.sure)
            for i in range(len(first) - 1):
                j = np.arange(i + 1, len(first))
                j = j[alike.close(np.full(len(j), i), j, least)]
                ones.append(np.full(len(j), long[first[i]]))
                twos.append(long[first[j]])
        return np.concatenate(ones), np.concatenate(twos), classes


def chains(i: np.ndarray, j: np.ndarray, size: int, gap_cost: float, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(i of the first seed, j of it, i of the last, j of it) of collinear chains.

    Seeds rise in both sequences along a chain; each is worth its ``size`` words and each
    word skipped in either sequence costs ``gap_cost``.  With the cost linear in i + j, the
    best predecessor is a maximum over all smaller j, which a Fenwick tree over the ranks of
    j gives.  Chains are taken from the best one down, without seeds taken before, as long
    as they span ``least`` words.
    """
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    ranks = np.unique(j, return_inverse=True)[1] + 1
    top = int(ranks.max(initial=0))
    best, owner = [-np.inf] * (top + 1), [-1] * (top + 1)
    n = len(i)
    score, back = np.zeros(n), np.full(n, -1)
    at = 0
    while at < n:
        same = at
        # Seeds at one i do not follow each other: ask for all of them before adding any.
        while same < n and i[same] == i[at]:
            value, previous, r = -np.inf, -1, int(ranks[same]) - 1
            while r > 0:
                if best[r] > value:
                    value, previous = best[r], owner[r]
                r -= r & -r
            joined = value - gap_cost * (i[same] + j[same]) + size
            score[same], back[same] = (joined, previous) if joined > size else (size, -1)
            same += 1
        for k in range(at, same):
            value, r = score[k] + gap_cost * (i[k] + j[k]), int(ranks[k])
            while r <= top:
                if value > best[r]:
                    best[r], owner[r] = value, k
                r += r & -r
        at = same
    taken = np.zeros(n, dtype=bool)
    for end in np.argsort(-score, kind="stable"):
        if taken[end]:
            continue
        first = k = end
        while k >= 0 and not taken[k]:
            taken[k], first, k = True, k, back[k]
        if i[end] - i[first] + size >= least and j[end] - j[first] + size >= least:
            yield int(i[first]), int(j[first]), int(i[end]), int(j[end])


def extend(a: np.ndarray, b: np.ndarray, reach: int = 12, sure: int = 3) -> tuple[int, int, int]:
    """(words of a, words of b, matches) of an alignment from the start of both.

    Words are matched while they are equal.  At a difference the nearest place, at most
    ``reach`` words on in either sequence, where ``sure`` words agree again is taken; the
    alignment ends behind the last match where there is none.
    """
    p = q = matches = 0
    while True:
        most = min(len(a) - p, len(b) - q)
        differs = np.flatnonzero(a[p : p + most] != b[q : q + most])
        same = int(differs[0]) if len(differs) else most
        p, q, matches = p + same, q + same, matches + same
        x, y = a[p : p + reach + sure], b[q : q + reach + sure]
        if len(x) < sure or len(y) < sure:
            return p, q, matches
        table = x[:, None] == y[None, :]
        ok = table[: len(x) - sure + 1, : len(y) - sure + 1].copy()
        for s in range(1, sure):
            ok &= table[s : len(x) - sure + 1 + s, s : len(y) - sure + 1 + s]
        dx, dy = np.nonzero(ok)
        if not len(dx):
            return p, q, matches
        near = np.argmin(np.maximum(dx, dy) * 64 + dx + dy)
        p, q = p + int(dx[near]), q + int(dy[near])


def align(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int, int, int, int]:
    """(start, end in a, start, end in b, matches) of the passage around words i and j."""
    ahead = extend(a[i:], b[j:])
    behind = extend(a[:i][::-1], b[:j][::-1])
    return i - behind[0], i + ahead[0], j - behind[1], j + ahead[1], ahead[2] + behind[2]
