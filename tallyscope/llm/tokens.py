"""Words, shingles and their 64-bit hashes, computed in numpy over the bytes of many texts at once.

A word is a maximal run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return;
A-Z are lower-cased. All of these are single bytes in UTF-8, so texts are never decoded.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are hashed together; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes between words: white space only, or everything in ASCII that is neither a letter nor a digit.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SEED = 0x5DEECE66D


def give_back() -> None:
    """Return memory that Arrow keeps for later batches: an idle worker stays alive beside those of the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = "2m"


def in_small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand rows to Python in small batches, so that long texts do not fill a worker's memory.

    Spark's own bound of 64 MB a batch is kept several times over: as rows, in Arrow, in the worker and in its answer.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet (names are compared without regard to case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix)."""
    x = values.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Odd:
    """Pseudo-random odd multipliers, as many as the longest word needed so far."""

    def __init__(self):
        self.values = np.empty(0, dtype=np.uint64)

    def upto(self, count: int) -> np.ndarray:
        if len(self.values) < count:
            self.values = mix(np.arange(_SEED, _SEED + 2 * count, dtype=np.uint64)) | np.uint64(1)
        return self.values


_multipliers = _Odd()


def text_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, and start and size of each (null: size 0), without copying the texts."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(ends)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_valid()), sizes, 0)
    return np.frombuffer(data or b"", dtype=np.uint8), ends[:-1], sizes


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and end byte of every word.

    ``bounds`` are the positions in ``data`` where one text ends and the next one starts, first and last included.
    """
    space = separators[data]
    at = np.flatnonzero(~space)
    if not len(at):
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none, none
    fresh = np.empty(len(data) + 1, dtype=bool)
    fresh[0], fresh[1:-1], fresh[-1] = True, space[:-1], True
    fresh[bounds] = True
    first = np.flatnonzero(fresh[at])
    counts = np.diff(first, append=len(at))
    within = np.arange(len(at)) - np.repeat(first, counts)
    terms = _multipliers.upto(int(counts.max()))[within]
    terms *= _LOWER[data[at]] + np.uint64(1)
    hashes = mix(np.add.reduceat(terms, first) + counts.astype(np.uint64))
    begin = at[first]
    doc = np.searchsorted(bounds, begin, side="right") - 1
    return hashes, doc, begin, begin + counts


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes, and bounds of runs of texts of about ``SLICE_BYTES``."""
    data, starts, sizes = text_parts(texts)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        own = sizes[first:last]
        part = [data[s : s + n] for s, n in zip(starts[first:last].tolist(), own.tolist(), strict=True)]
        yield first, np.concatenate(part), np.concatenate([[0], np.cumsum(own)])
        first = last


def grams(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every run of ``size`` words within one text."""
    count = len(words) - size + 1
    if count <= 0:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    total = np.zeros(count, dtype=np.uint64)
    odd = _multipliers.upto(size)
    for k in range(size):
        total += odd[k] * words[k : k + count]
    first = np.flatnonzero(doc[:count] == doc[size - 1 :])
    return mix(total[first]), doc[first], first


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words than ``size`` has one shingle, the whole sequence; one without words has none.
    """
    for _, data, bounds in slices(texts):
        words, doc, _, _ = word_hashes(data, bounds)
        hashes, owner, _ = grams(words, doc, size)
        count = len(bounds) - 1
        n_words = np.bincount(doc, minlength=count)
        word_at = np.concatenate([[0], np.cumsum(n_words)])
        gram_at = np.searchsorted(owner, np.arange(count + 1))
        for k in range(count):
            if n_words[k] >= size:
                yield np.unique(hashes[gram_at[k] : gram_at[k + 1]])
            elif n_words[k]:
                own = words[word_at[k] : word_at[k + 1]]
                total = (own * _multipliers.upto(len(own))[: len(own)]).sum() + np.uint64(len(own))
                yield mix(mix(np.array([total], dtype=np.uint64)))
            else:
                yield np.empty(0, dtype=np.uint64)
