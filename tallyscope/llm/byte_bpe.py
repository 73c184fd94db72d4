"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every leaf of the tree stands for a byte position that starts a live token and holds the rank of
the pair it forms with the next live token, together with the position, so that the root is the
leftmost pair of minimum rank. A merge changes three leaves and the path above each of them.

Short pieces are merged many at a time: their trees are rows of one array and every step updates one
pair per row. Long pieces have a tree of their own, so that a piece of n bytes costs n log n.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F, types as T

from tallyscope.llm.tokens import give_back

#: Pieces of up to this many bytes are merged in batches; a batch holds about this many leaves.
BATCH_PIECE = 64
BATCH_LEAVES = 1 << 17
#: Encoded pieces a task remembers. Beyond it, and at the task's end, the memory is emptied; results do not depend on it.
REMEMBERED = 150_000
#: Characters of text split into pieces at once.
SLICE_CHARS = 1 << 19

_NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder of one vocabulary; ``pattern`` cuts a text into pieces that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[key] for key in self.pair_keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    # pieces

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1, dtype=np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > BATCH_PIECE:
                out[i] = np.array(self.merge_long(piece), dtype="<u4").tobytes()
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, BATCH_LEAVES // width)
            for start in range(0, len(members), step):
                chosen = members[start : start + step]
                for i, ids in zip(chosen, self._merge_rows([pieces[i] for i in chosen], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merge pieces of at most ``width`` bytes together, one tree per row."""
        count = len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
        raw = np.frombuffer(b"".join(piece.ljust(width, b"\0") for piece in pieces), dtype=np.uint8)
        ids = self.byte_ids[raw.reshape(count, width)]
        place = np.arange(width)
        live = place < sizes[:, None]
        following = np.where(place + 1 < sizes[:, None], place + 1, width)
        preceding = np.broadcast_to(place - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), _NONE, dtype=np.int64)
        paired = place + 1 < sizes[:, None]
        rank = np.full((count, width), -1, dtype=np.int64)
        right = np.roll(ids, -1, axis=1)
        rank[paired] = self._ranks_of(ids[paired], right[paired])
        tree[:, width:] = np.where(rank >= 0, rank * width + place, _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best % width
            gone = following[rows, at]
            after = following[rows, gone]
            ids[rows, at] = best // width
            live[rows, gone] = False
            following[rows, at] = after
            has_after = after < width
            preceding[rows[has_after], after[has_after]] = at[has_after]
            before = preceding[rows, at]
            has_before = before >= 0
            self._point(tree, width, rows, gone, None, None)
            fresh = np.full(len(rows), -1, dtype=np.int64)
            fresh[has_after] = self._ranks_of(
                ids[rows[has_after], at[has_after]], ids[rows[has_after], after[has_after]]
            )
            self._point(tree, width, rows, at, fresh, at)
            rows_b, before_b, at_b = rows[has_before], before[has_before], at[has_before]
            self._point(
                tree, width, rows_b, before_b, self._ranks_of(ids[rows_b, before_b], ids[rows_b, at_b]), before_b
            )
            rows = rows[tree[rows, 1] != _NONE]
        packed = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        starts = ends - live.sum(axis=1) * 4
        return [packed[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def _point(tree, width, rows, leaf, rank, place) -> None:
        """Set one leaf per row and mend the minima above it."""
        node = leaf + width
        tree[rows, node] = _NONE if rank is None else np.where(rank >= 0, rank * width + place, _NONE)
        node = node >> 1
        while width > 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1
            node = node >> 1

    def merge_long(self, piece: bytes) -> list[int]:
        """Merge one piece of any length by its own tree."""
        size = len(piece)
        width = 1 << max(0, size - 1).bit_length()
        pairs, none = self.pairs, 1 << 62
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        following, preceding = list(range(1, size + 1)), list(range(-1, size - 1))
        tree = [none] * (2 * width)
        for i in range(size - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def point(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            node >>= 1
            while node:
                low = tree[2 * node] if tree[2 * node] < tree[2 * node + 1] else tree[2 * node + 1]
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        def pair_at(left: int, right: int) -> int:
            rank = pairs.get(ids[left] << 32 | ids[right]) if right < size else None
            return none if rank is None else rank * width + left

        while size > 1 and tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = following[at]
            after = following[gone]
            ids[at], ids[gone], following[at] = rank, -1, after
            if after < size:
                preceding[after] = at
            point(gone, none)
            point(at, pair_at(at, after))
            if preceding[at] >= 0:
                point(preceding[at], pair_at(preceding[at], at))
        return [token for token in ids if token >= 0]

    # texts

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Packed ids of every text; a null text has none."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        held = 0

        def flush() -> None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            fresh = list(set().union(*waiting).difference(self.known))
            self.known.update(zip(fresh, self.encode_pieces([p.encode() for p in fresh]), strict=True))
            find = self.known.__getitem__
            out.extend(b"".join(map(find, pieces)) for pieces in waiting)
            waiting.clear()

        for text in texts:
            waiting.append(self.pattern.findall(text or ""))
            held += len(text or "")
            if held >= SLICE_CHARS:
                flush()
                held = 0
        flush()
        return out

    def decode(self, packed: Iterable[bytes | None]) -> list[bytes]:
        """Bytes that packed ids stand for. An id outside the vocabulary is an error."""
        find = self.token_bytes.__getitem__
        return [b"".join(map(find, np.frombuffer(ids or b"", dtype="<u4").tolist())) for ids in packed]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec of one vocabulary file, which is read once and installed on every worker."""
    return ByteBpe(read_ranks(path), pattern)


def encoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: text to its token ids, packed as little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens (an empty binary). Special tokens are ordinary text.
    """

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            yield pa.array(own.encode(texts.to_pylist()), type=pa.binary())
        own.known.clear()
        give_back()

    return encode


def decoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: packed token ids back to bytes; null ids decode to no bytes."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for packed in batches:
            yield pa.array(codec(path, pattern).decode(packed.to_pylist()), type=pa.binary())
        give_back()

    return decode


def id_array(packed: Column) -> Column:
    """Packed ids as an array of integers, for callers that want one value per token."""
    digits = F.regexp_extract_all(F.hex(packed), F.lit("(..)(..)(..)(..)"), F.lit(0))
    return F.transform(
        digits,
        lambda d: F.conv(
            F.concat(F.substring(d, 7, 2), F.substring(d, 5, 2), F.substring(d, 3, 2), F.substring(d, 1, 2)), 16, 10
        ).cast("bigint"),
    )
