"""Vantage-point trees over fingerprints of 64 bits, for pairs within a Hamming distance.

A tree splits its points by their distance to a vantage point: those within the median
radius go left, the rest right.  For a query with reach r the triangle inequality rules out
the left side if its distance exceeds radius + r, and the right side if distance + r does
not exceed the radius.

Two fingerprints that differ in at most 2r + 1 bits differ in at most r bits in one of
their halves.  So there is a tree over each half with half the reach, which prunes far more
than one tree over the whole (distances between unrelated fingerprints crowd around half
their length, and the band around a radius that a query may not rule out shrinks with the
reach).  Candidates are compared on all bits.
"""

from __future__ import annotations

import numpy as np

_LEAF = 48
# Cells of a comparison, and pairs to be merged, that are held at once.
_BLOCK = 2_000_000


def _points(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint32)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def top_tree(sample, depth: int, seed: int = 7) -> list[tuple[int, int]]:
    """(vantage point, radius) per node of a full binary tree, in heap order, each radius the
    median over the part of the sample that reaches the node."""
    draw = np.random.default_rng(seed)
    nodes: list[tuple[int, int]] = []
    parts = [_points(sample)]
    for _ in range(depth):
        below = []
        for part in parts:
            point = part[draw.integers(len(part))] if len(part) else np.uint32(draw.integers(2**32))
            away = distance(part, point)
            radius = int(np.median(away)) if len(part) else 16
            nodes.append((int(point), radius))
            below += [part[away <= radius], part[away > radius]]
        parts = below
    return nodes


def shards_of(values, nodes: list[tuple[int, int]], reach: int):
    """(row, shard, home): for each value the shard it lives in, and those its ball of
    ``reach`` overlaps."""
    values = _points(values)
    row = np.arange(len(values))
    node = np.zeros(len(values), dtype=np.int64)
    home = np.ones(len(values), dtype=bool)
    depth = (len(nodes) + 1).bit_length() - 1
    point = np.array([n[0] for n in nodes], dtype=np.uint32)
    radius = np.array([n[1] for n in nodes], dtype=np.int64)
    for _ in range(depth):
        away = distance(values[row], point[node]).astype(np.int64)
        left, right = away - reach <= radius[node], away + reach > radius[node]
        inside = away <= radius[node]
        row = np.concatenate([row[left], row[right]])
        home = np.concatenate([(home & inside)[left], (home & ~inside)[right]])
        node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node - len(nodes), home


def _split(points, rows, draw, gap):
    """A vantage point and radius that leave some of the rows on either side, or None if all
    of a few points tried see every row at one distance."""
    for _ in range(4):
        point = points[rows[draw.integers(len(rows))]]
        away = gap(points[rows], point)
        radius = int(np.median(away))
        if not (away > radius).any():
            radius = int(away.max()) - 1
        inside = away <= radius
        if inside.any():
            return point, radius, inside
    return None


def near_pairs(halves, members, queries, reach: int, limit: int, seed: int = 7, gap=distance):
    """Blocks of (member, query) indices whose fingerprints differ in at most ``limit`` bits.

    ``halves`` takes fingerprints to the half that this shard is about, on which they differ
    in at most ``reach`` bits; ``gap`` is the distance of whole ones.  A tree is grown over the members and all queries walk down
    with it.  Members that agree too well in their halves are split by the whole fingerprint
    instead.  Where few are left, they are compared with the queries in blocks.
    """
    draw = np.random.default_rng(seed)
    metrics = [
        (halves(members), halves(queries), reach, distance),
        (members, queries, limit, gap),
    ]
    todo = [(np.arange(len(members)), np.arange(len(queries)), 0)]
    while todo:
        here, asked, level = todo.pop()
        if not len(here) or not len(asked):
            continue
        found = None
        while len(here) > _LEAF and level < 2 and found is None:
            found = _split(metrics[level][0], here, draw, metrics[level][3])
            level += found is None
        if found is None:
            step = max(1, _BLOCK // len(here))
            for i in range(0, len(asked), step):
                block = asked[i : i + step]
                close = gap(members[here][:, None], queries[block][None, :]) <= limit
                m, q = np.nonzero(close)
                if len(m):
                    yield here[m], block[q]
            continue
        point, radius, inside = found
        _, questions, near, away_from = metrics[level]
        away = away_from(questions[asked], point).astype(np.int64)
        todo.append((here[inside], asked[away - near <= radius], level))
        todo.append((here[~inside], asked[away + near > radius], level))


class Forest:
    """Labels of connected rows; pairs come in blocks and are merged many at a time."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self._waiting.append((a, b))
        self._count += len(a)
        if self._count > _BLOCK:
            self.merge()

    def merge(self) -> np.ndarray:
        if self._waiting:
            a, b = (np.concatenate(x) for x in zip(*self._waiting))
            self._waiting, self._count = [], 0
            while True:
                x, y = self.label[a], self.label[b]
                if (x == y).all():
                    break
                np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(above := self.label[self.label], self.label):
                    self.label = above
        return self.label
