"""Enhanced suffix array over a few byte strings, and its maximal repeats.

Suffixes are sorted by prefix doubling; the ranks of each doubling give the common prefix
of neighbours.  The intervals of common prefixes form a tree that a stack scan walks; an
interval is a maximal repeat if the bytes before its suffixes are not all the same.
"""

from __future__ import annotations

import numpy as np

# Bytes that fit into the first rank together, with room for the end of a string.
_FIRST = 7


def _ranked(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return rank


def _ranks(symbols: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of the string of that length at each place) for doubling lengths."""
    padded = np.concatenate([symbols, np.zeros(_FIRST, dtype=np.int64)])
    packed = np.zeros(len(symbols), dtype=np.int64)
    for i in range(_FIRST):
        packed = (packed << 9) | padded[i : i + len(symbols)]
    levels, length = [(_FIRST, _ranked(packed))], _FIRST
    while length < longest:
        rank = levels[-1][1]
        ahead = np.zeros_like(rank)
        if length < len(rank):
            ahead[:-length] = rank[length:] + 1
        levels.append((2 * length, _ranked(rank * (len(rank) + 1) + ahead)))
        length *= 2
    return levels


def _common(levels, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix at places ``a`` and ``b``, at most ``most``."""
    size, done = len(symbols), np.zeros(len(a), dtype=np.int64)
    for length, rank in reversed(levels):
        x, y = a + done, b + done
        inside = (x < size) & (y < size)
        same = inside & (rank[np.minimum(x, size - 1)] == rank[np.minimum(y, size - 1)])
        done += np.where(same, length, 0)
    going = np.ones(len(a), dtype=bool)
    for _ in range(_FIRST - 1):
        x, y = a + done, b + done
        going &= (x < size) & (y < size)
        going &= symbols[np.minimum(x, size - 1)] == symbols[np.minimum(y, size - 1)]
        done += going
    return np.minimum(done, most)


def longest_repeats(strings: list[bytes], least: int):
    """(place, length, string, offset) arrays: the longest maximal repeat at every place that
    has one."""
    return maximal_repeats(strings, least, longest=True)


def maximal_repeats(strings: list[bytes], least: int, longest: bool = False):
    """(repeat, length, string, offset) arrays: every substring of at least ``least`` bytes
    that starts at two places or more and cannot be extended to the left or right at all of
    them, with all its places.  Repeats do not cross the ends of strings.

    Each repeat lists its places, so nested repeats list a place several times;
    :func:`longest_repeats` lists each place once.
    """
    sizes = np.fromiter((len(s) for s in strings), np.int64, len(strings))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    data = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    data[begin + sizes] = 0
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    left_over = (begin + sizes)[owner] - np.arange(len(data))
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if sizes.max(initial=0) < least:
        return none
    levels = _ranks(data, int(sizes.max()))
    places = np.flatnonzero(left_over >= least)
    places = places[np.argsort(levels[-1][1][places], kind="stable")]
    a, b = places[:-1], places[1:]
    common = _common(levels, data, a, b, np.minimum(left_over[a], left_over[b]))
    # Before the first byte of a string stands a mark of its own.
    before = np.where(places == begin[owner[places]], -1 - owner[places], data[places - 1])
    joined = np.flatnonzero(common >= least)
    if not len(joined):
        return none
    breaks = np.flatnonzero(np.diff(joined) > 1)
    firsts = joined[np.concatenate([[0], breaks + 1])]
    lasts = joined[np.concatenate([breaks, [len(joined) - 1]])] + 1
    # An interval whose suffixes all follow the same byte holds no maximal repeat.
    differs = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    diverse = differs[lasts] > differs[firsts]
    found = []
    for first, last in zip(firsts[diverse], lasts[diverse]):
        found += _intervals(common[first:last], before[first : last + 1], first)
    if not found:
        return none
    if longest:
        # Inner intervals come before those around them, so in reverse the inner ones win.
        depth = np.zeros(len(places), dtype=np.int64)
        for size, low, high in reversed(found):
            depth[low:high] = size
        at = np.flatnonzero(depth)
        where = places[at]
        return at, depth[at], owner[where], where - begin[owner[where]]
    number = np.repeat(np.arange(len(found)), [high - low for _, low, high in found])
    length = np.repeat([depth for depth, _, _ in found], [high - low for _, low, high in found])
    where = places[np.concatenate([np.arange(low, high) for _, low, high in found])]
    return number, length, owner[where], where - begin[owner[where]]


def _intervals(common: np.ndarray, before: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(length, first, end) of the intervals with diverse bytes before them, by a scan of the
    common prefixes with a stack of the intervals that are still open."""
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common.tolist(), 0]):
        start = i
        while stack and stack[-1][0] > depth:
            length, start = stack.pop()
            if changes[i] > changes[start]:
                out.append((length, shift + start, shift + i + 1))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))
    return out
