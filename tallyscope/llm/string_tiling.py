"""Benchmark decontamination by greedy string tiling.

Words (runs of letters and digits, without regard to case in A-Z) of a document and of a benchmark item are tiled: the
longest runs they share are marked first, by running Karp-Rabin with a falling search length, and no marked word is used
again. The share of the item that is covered by tiles does not depend on their order, so reordered passages count.

Only pairs are tiled whose shared seeds (runs of the least tile length) could cover enough of the item: every tile consists
of seeds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tallyscope.llm.tokens import PUNCTUATION, free_names, grams, in_small_batches, slices, word_hashes

#: Fewest words of a tile, and the part of an item in percent that must be tiled.
TILE, COVERED = 4, 60
#: Words of benchmark items that one pass over the documents looks for; more items take more passes.
BLOCK_WORDS = 2_000_000

_MATCHES = pa.list_(
    pa.struct(
        [
            ("item_id", pa.string()),
            ("covered", pa.int32()),
            ("words", pa.int32()),
            ("tiles", pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )
)


_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


def _running(words: list[int], used: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """Start and Karp-Rabin hash of every unmarked run of ``size`` words, each from the one before it."""
    lead = pow(_BASE, size - 1, _MODULUS)
    at, count = used.find(0), len(words)
    while at >= 0:
        end = used.find(1, at)
        end = count if end < 0 else end
        if end - at >= size:
            value = 0
            for word in words[at : at + size]:
                value = (value * _BASE + word) % _MODULUS
            yield at, value
            for start in range(at + 1, end - size + 1):
                value = ((value - words[start - 1] * lead) * _BASE + words[start + size - 1]) % _MODULUS
                yield start, value
        at = used.find(0, end)


def _shared(item: list[int], item_used: bytearray, i: int, text: list[int], text_used: bytearray, j: int) -> int:
    """Length of the equal, unmarked run from both places."""
    size, most = 0, min(len(item) - i, len(text) - j)
    while size < most and item[i + size] == text[j + size] and not (item_used[i + size] or text_used[j + size]):
        size += 1
    return size


def tile(
    item: list[int], text: list[int], least: int = TILE, closed: bytearray | None = None
) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of greedy string tiling of two word sequences.

    Ties between equally long matches go to the earlier place in the item, then in the text. ``closed`` marks words of the
    text that cannot be part of a match.
    """
    tiles: list[tuple[int, int, int]] = []
    item_used, text_used = bytearray(len(item)), bytearray(closed or len(text))
    search = max(least, min(len(item), len(text)) // 2)
    while True:
        table = defaultdict(list)
        for here, value in _running(item, item_used, search):
            table[value].append(here)
        found = []
        for there, value in _running(text, text_used, search) if table else ():
            for here in table.get(value, ()):
                size = _shared(item, item_used, here, text, text_used, there)
                if size >= search:
                    found.append((-size, here, there))
        # Longest first; what an earlier tile has cut is found again, shorter, by the next search length.
        retry = False
        for size, here, there in sorted(found):
            left = _shared(item, item_used, here, text, text_used, there)
            if left == -size:
                item_used[here : here + left] = text_used[there : there + left] = b"\1" * left
                tiles.append((here, there, left))
            elif left >= search:
                retry = True
        if retry:
            continue
        if search == least:
            return tiles
        search = max(least, search // 2)


class ItemBlock:
    """Words and seeds of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], least: int):
        self.least = least
        self.names = [name for name, _ in items]
        texts = pa.array([text for _, text in items], type=pa.string())
        self.words: list[np.ndarray] = []
        seeds, owner, place = [], [], []
        for first, data, bounds in slices(texts):
            hashes, doc, _, _ = word_hashes(data, bounds, PUNCTUATION)
            gram, gram_doc, at = grams(hashes, doc, least)
            cuts = np.searchsorted(doc, np.arange(len(bounds)))
            self.words += [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            seeds.append(gram)
            owner.append(gram_doc + first)
            place.append(at - cuts[gram_doc])
        empty = np.empty(0, dtype=np.int64)
        self.seeds = np.concatenate([*seeds, empty.astype(np.uint64)])
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owner = np.concatenate([*owner, empty])[order]
        self.place = np.concatenate([*place, empty])[order]

    def matches(self, texts: pa.Array, percent: int) -> list[list[dict]]:
        """Per text: the items that are covered by at least ``percent``, with their tiles in words."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not len(self.seeds):
            return out
        for first, data, bounds in slices(texts):
            words, doc, _, _ = word_hashes(data, bounds, PUNCTUATION)
            gram, gram_doc, at = grams(words, doc, self.least)
            low = np.searchsorted(self.seeds, gram)
            hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == gram)
            if not len(hit):
                continue
            low = low[hit]
            high = np.searchsorted(self.seeds, gram[hit], side="right")
            cuts = np.searchsorted(doc, np.arange(len(bounds)))
            own: dict[tuple[int, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
            for k, a, b in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True):
                for seed in range(a, b):
                    pair = own[int(gram_doc[k]), int(self.owner[seed])]
                    pair[0].append(int(at[k]))
                    pair[1].append(int(self.place[seed]))
            for (number, item), (there, here) in sorted(own.items()):
                size = len(self.words[item])
                if self._reach(size, here) * 100 < percent * size:
                    continue
                text = words[cuts[number] : cuts[number + 1]]
                closed = np.ones(len(text), dtype=np.uint8)
                for k in range(self.least):
                    closed[np.array(there) - cuts[number] + k] = 0
                found = tile(self.words[item].tolist(), text.tolist(), self.least, bytearray(closed.tobytes()))
                covered = sum(length for _, _, length in found)
                if covered * 100 >= percent * size:
                    out[first + number].append(
                        {
                            "item_id": self.names[item],
                            "covered": covered,
                            "words": size,
                            "tiles": [{"item": i, "start": j, "end": j + n} for i, j, n in sorted(found)],
                        }
                    )
        return out

    def _reach(self, size: int, places: list[int]) -> int:
        """Words of the item that lie in a shared seed: no tiling covers more."""
        inside = np.zeros(size, dtype=bool)
        for k in range(self.least):
            inside[np.array(places) + k] = True
        return int(inside.sum())


def blocks(items: DataFrame, id_col: str, text_col: str, least: int = TILE) -> list[Broadcast]:
    """The items in broadcast blocks of about ``BLOCK_WORDS`` words, whatever their number.

    Items with fewer words than a tile are matched by no document, so are null and empty ones.
    """
    text = F.col(f"`{text_col}`")
    sized = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text")).filter(text.isNotNull())
    total = sized.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    count = 1 + total // (6 * BLOCK_WORDS)
    out = []
    for number in range(count):
        block = sized.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == number).collect()
        out.append(items.sparkSession.sparkContext.broadcast(ItemBlock(sorted((r.id or "", r.text) for r in block), least)))
    return out


def matches(text: Column, found: list[Broadcast], percent: int = COVERED) -> Column:
    """Array of the items that a text covers: id, covered words, words, tiles (item start, text start and end in words)."""

    def one(block: Broadcast) -> Column:
        @F.arrow_udf(from_arrow_type(_MATCHES))
        def match(texts: pa.Array) -> pa.Array:
            return pa.array(block.value.matches(texts, percent), type=_MATCHES)

        return match(text)

    return F.concat(*[one(block) for block in found])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = COVERED,
    least: int = TILE,
) -> DataFrame:
    """One row per contaminated document: ``id_col, matches``.

    A document is contaminated by every item of which at least ``percent`` of the words lie in tiles of ``least`` words
    or more. Null and empty texts, and items with fewer than ``least`` words, match nothing; null ids stay null; repeated
    rows give repeated rows; other columns are not carried; without documents or items the result is empty.
    """
    found = blocks(items, item_id_col, item_text_col, least)
    judged = in_small_batches(docs).select(F.col(f"`{id_col}`"), matches(F.col(f"`{text_col}`"), found, percent).alias("matches"))
    return judged.filter(F.size("matches") > 0)


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    found = blocks(items, item_id_col, item_text_col)
    (name,) = free_names(docs, "matches")
    judged = in_small_batches(docs).withColumn(name, F.size(matches(F.col(f"`{text_col}`"), found)))
    return judged.filter(F.col(name) == 0).drop(name)
