"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is split into pre-tokens by the tokenizer's pattern.  The pre-tokens of a batch that
are not known yet are looked up together: a minimal perfect hash over the vocabulary gives
each a slot, and those that equal the entry there are one token.  The others are merged:
their bytes form a linked list, a heap holds the neighbours that are a token together by
(rank, place), and the least is joined until none is left.  A place in the heap whose parts
have changed since is passed over.

Every rank file is read once, by the driver; vocabularies are bounded and go to the tasks
with the function.  Texts are worked on where they lie, without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .perfect_hash import PerfectHash

RANKS = "byte_bpe_multi_50k.tiktoken"
# Pre-tokens that a worker remembers; it starts anew beyond that.
KNOWN = 1_000_000
# Code points of a text that are split at once, and how far a match may look past its end.
STRETCH = 1_000_000
LOOK_AHEAD = 8

# Letters and numbers of Unicode versions after 16, which the installed
# pattern engine knows and the tokenizer's own does not: first and last code points.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = (
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16FF4, 0x16FF6),
)


def _set(ranges) -> str:
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a pre-token: neighbours of the least rank are joined, the leftmost of
    equals first, until no neighbours are a token together."""
    ends = list(range(1, len(piece) + 1))  # of the part that starts here
    before = list(range(-1, len(piece) - 1))
    heap = []
    for i in range(len(piece) - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    size = len(piece)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        # Both parts must still be there and reach just this far.
        if middle < 0 or middle >= end or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, -1
        if end < size:
            before[end] = i
            rank = ranks.get(piece[i : ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if i:
            left = before[i]
            rank = ranks.get(piece[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end))
    tokens, i = [], 0
    while i < size:
        tokens.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return tokens


class Vocabulary:
    """The tokens of a rank file in the order of their slots, and the pattern that splits
    texts.  Every single byte must be a token.  Matches of the pattern must cover the text
    and depend on no more than ``LOOK_AHEAD`` characters past their end."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.tokens: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(tokens).tolist()):
            self.tokens[slot] = token
        self.ids = np.array([ranks[token] for token in self.tokens], dtype="<u4")
        self.pattern = pattern

    def encoder(self) -> Encoder:
        return Encoder(self)

    def pieces(self) -> dict[int, bytes]:
        return dict(zip(self.ids.tolist(), self.tokens))


class Encoder:
    """Texts to token ids; knows the pre-tokens it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ranks = dict(zip(vocabulary.tokens, vocabulary.ids.tolist()))
        self.known: dict[str, bytes] = {}
        self.plain = regex.compile(vocabulary.pattern)
        self.newer = {
            chr(c) for a, b in NEWER_LETTERS + NEWER_NUMBERS for c in range(a, b + 1)
        }
        exact = vocabulary.pattern
        for name, ranges in ((r"\p{L}", NEWER_LETTERS), (r"\p{N}", NEWER_NUMBERS)):
            exact = exact.replace(name, f"[{name}--{_set(ranges)}]")
        self.exact = regex.compile(exact, regex.V1)

    def _resolved(self, pieces: list[str]) -> list[bytes]:
        """Ids, four bytes each, of distinct pre-tokens."""
        keys = [piece.encode() for piece in pieces]
        slots = self.vocabulary.hash.slots(keys)
        ids, tokens = self.vocabulary.ids, self.vocabulary.tokens
        return [
            ids[slot].tobytes()
            if tokens[slot] == key
            else np.array(merged(key, self.ranks), dtype="<u4").tobytes()
            for key, slot in zip(keys, slots.tolist())
        ]

    def _packed(self, text: str, start: int, end: int, more: bool) -> tuple[bytes, int]:
        """Ids of ``text[start:end]``, and where they end: if there is more text, before the
        last matches, as what follows may belong to them."""
        pieces = self.plain.findall(text, start, end)
        fresh = set(pieces).difference(self.known)
        own: dict[str, bytes] = {}
        if any(not self.newer.isdisjoint(piece) for piece in fresh):
            pieces = self.exact.findall(text, start, end)
            fresh = set(pieces).difference(self.known)
            own = {piece: b"" for piece in fresh if not self.newer.isdisjoint(piece)}
        if more:
            stop = end - LOOK_AHEAD
            while pieces and end > stop:
                end -= len(pieces.pop())
        if fresh:
            if len(self.known) > KNOWN:
                self.known, fresh = {}, set(pieces)
            fresh = list(fresh)
            for piece, packed in zip(fresh, self._resolved(fresh)):
                (own if piece in own else self.known)[piece] = packed
        known = self.known
        if own:
            known = {piece: own.get(piece) or known[piece] for piece in set(pieces)}
        return b"".join(map(known.__getitem__, pieces)), end

    def encode(self, text: str) -> bytes:
        """The ids of a text, as unsigned little-endian numbers of four bytes."""
        if len(text) <= STRETCH:
            return self._packed(text, 0, len(text), False)[0]
        parts, start, stretch = [], 0, STRETCH
        while start < len(text):
            stop = min(start + stretch, len(text))
            part, end = self._packed(text, start, stop, stop < len(text))
            stretch = STRETCH if end > start else 2 * stretch
            start = end
            parts.append(part)
        return b"".join(parts)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document: doc_id, n_tokens, and ids as unsigned little-endian numbers of four
    bytes each, without special tokens.

    A null text counts as empty and has no tokens.  Rows keep their ids, null and repeated
    ones too, and each row is encoded for itself.  An empty table gives no rows.  Other
    columns are not looked at, whatever their names.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            ids = [encoder.encode(text.as_py() or "") for text in batch.column(1)]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.record_batch(
                [batch.column(0), counts, pa.array(ids, pa.binary())], names=names
            )

    rows = pick(docs, "doc_id", "text")
    names = ["doc_id", "n_tokens", "ids"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``tokens``, as of :func:`encoded`, with the bytes of its ids as ``decoded``.

    No ids give no bytes, null ids null.  An id without a token is an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabulary.pieces().__getitem__
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                packed = ids.as_py()
                numbers = packed and np.frombuffer(packed, dtype="<u4").tolist()
                texts.append(None if packed is None else b"".join(map(piece, numbers)))
            yield pa.record_batch(
                [*batch.columns, pa.array(texts, pa.binary())],
                names=[*batch.schema.names, "decoded"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(decode, f"{ddl}, decoded binary")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its ids and of what they decode to.

    ``ranks`` is the path of a rank file on the driver; odd rows are as :func:`encoded` says.
    """
    vocabulary = Vocabulary(ranks or public_tokenizers.path(RANKS))
    return decoded(encoded(docs, vocabulary), vocabulary).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
