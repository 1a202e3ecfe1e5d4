"""A minimal perfect hash over byte strings: as many slots as keys, one key a slot.

Keys are dealt into buckets of about four by their 64-bit digest.  Buckets take their slots
in order of size: a bucket tries displacements until all its keys fall on free slots, and a
bucket of one key is sent to a free slot directly.  A string that is no key falls on some
slot too, so the key found there is compared with it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_BUCKET = 4
_MASK = 2**64 - 1


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _slots(digests: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    moved = displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(digests ^ moved) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``slots(keys)`` is a different number below ``len(keys)`` for each key."""

    def __init__(self, keys: Sequence[bytes]):
        self.size, self.seed = len(keys), 0
        self.buckets = self.size // _BUCKET + 1
        while len(np.unique(digests := self._digests(keys))) < self.size:
            if len(set(keys)) < self.size:
                raise ValueError("the keys are not distinct")
            self.seed += 1
        self.displacement = np.zeros(self.buckets, dtype=np.int64)
        bucket = (digests % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        taken = np.zeros(self.size, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            self.displacement[b] = self._place(digests[order[starts[b] : starts[b + 1]]], taken)
        free = np.flatnonzero(~taken)
        self.displacement[sizes == 1] = -1 - free

    def _digests(self, keys: Sequence[bytes]) -> np.ndarray:
        digest, seed = xxhash.xxh3_64_intdigest, self.seed
        return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))

    def _place(self, digests: np.ndarray, taken: np.ndarray) -> int:
        """The least displacement that sends the digests to free slots, which are then taken."""
        first, tries = 0, 32
        while True:
            moves = np.arange(first, first + tries)
            slots = np.sort(_slots(digests[:, None], moves[None, :], self.size), axis=0)
            fits = ~taken[slots].any(axis=0) & (slots[1:] != slots[:-1]).all(axis=0)
            if fits.any():
                at = int(fits.argmax())
                taken[slots[:, at]] = True
                return first + at
            first, tries = first + tries, min(4 * tries, 4096)

    def slots(self, keys: Sequence[bytes]) -> np.ndarray:
        digests = self._digests(keys)
        moves = self.displacement[(digests % np.uint64(self.buckets)).astype(np.int64)]
        hashed = _slots(digests, np.maximum(moves, 0), self.size)
        return np.where(moves < 0, -1 - moves, hashed)
