"""Removal of line chunks that repeat across the corpus.

A rolling hash over the hashes of the last lines of a text ends a chunk wherever it hits a residue, so boundaries depend
on a few neighbouring lines only and move along with them when lines are put in or taken out elsewhere. Chunks of two lines
or more that occur again, anywhere in the corpus, are removed except for their first occurrence. Hashes only find
candidates; chunks count as equal when their bytes are.
The first occurrence of a chunk always stays, so nothing that is removed is gone from the corpus. Lines of a repeated block before its
first and after its last inner boundary belong to chunks that differ, and stay.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tallyscope.llm.tokens import free_names, in_small_batches
from tallyscope.session import settle

#: Lines under the rolling hash, its residue classes (chunks end at one of them) and the fewest lines of a chunk.
ROLLED, RESIDUES, FEWEST = 2, 3, 2

_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_CHUNKS = pa.list_(pa.struct([("nth", pa.int32()), ("hash", pa.int64()), ("body", pa.string())]))


def cut(text: str) -> list[list[str]]:
    """The lines of a text (split at line feeds) as chunks; their concatenation is the text."""
    lines = text.split("\n")
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    drop = pow(_PRIME, ROLLED, 1 << 64)
    chunks, start, rolled = [], 0, 0
    for at, value in enumerate(hashes):
        rolled = (rolled * _PRIME + value) & _MASK
        if at >= ROLLED:
            rolled = (rolled - hashes[at - ROLLED] * drop) & _MASK
        if at + 1 - start >= FEWEST and (rolled >> 32) % RESIDUES == 0:
            chunks.append(lines[start : at + 1])
            start = at + 1
    if start < len(lines):
        chunks.append(lines[start:])
    return chunks


@F.arrow_udf(from_arrow_type(_CHUNKS))
def chunks_of(texts: pa.Array) -> pa.Array:
    """Column function: number, hash and body of the chunks that have ``FEWEST`` lines or more and a word."""
    rows = []
    for text in texts.to_pylist():
        own = []
        for nth, lines in enumerate(cut(text) if text else ()):
            if len(lines) >= FEWEST:
                body = "\n".join(lines)
                if body.strip():
                    own.append({"nth": nth, "hash": xxhash.xxh64_intdigest(body) - (1 << 63), "body": body})
        rows.append(own)
    return pa.array(rows, type=_CHUNKS)


_REBUILT = pa.struct([("text", pa.string()), ("lines", pa.int64()), ("removed_lines", pa.int64())])


@F.arrow_udf(from_arrow_type(_REBUILT))
def without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Column function: the text without its chunks of these numbers, its lines and how many of them went."""
    rows = []
    for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
        if not text or not gone:
            rows.append({"text": text, "lines": text.count("\n") + 1 if text else 0, "removed_lines": 0})
            continue
        chunks, gone = cut(text), set(gone)
        kept = [line for nth, lines in enumerate(chunks) if nth not in gone for line in lines]
        count = sum(map(len, chunks))
        rows.append({"text": "\n".join(kept), "lines": count, "removed_lines": count - len(kept)})
    return pa.array(rows, type=_REBUILT)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, nth, keeper_id, keeper_nth``: chunks to remove, and the first of each.

    The first occurrence is the smallest (id, text hash, number); nulls come first.
    """
    text = F.col(f"`{text_col}`")
    cut_up = in_small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), chunks_of(text).alias("chunks"))
    each = cut_up.select("id", "text_key", F.inline("chunks"))
    # Two occurrences differ in their place or in their document.
    again = each.groupBy("hash").agg(F.count("*").alias("seen")).filter("seen > 1").select("hash")
    found = settle(each.join(again, "hash", "left_semi"))
    place = F.struct("id", "text_key", "nth")
    first = found.groupBy("hash", "body").agg(F.min(place).alias("keeper"))
    return (
        found.join(first, ["hash", "body"])
        .filter(~place.eqNullSafe(F.col("keeper")))
        .select("id", "text_key", "nth", F.col("keeper.id").alias("keeper_id"), F.col("keeper.nth").alias("keeper_nth"))
    )


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, removed``: the chunk numbers to remove, one row per document that loses any."""
    gone = repeated_chunks(docs, id_col, text_col)
    return gone.groupBy("id", "text_key").agg(F.collect_set("nth").alias("removed"))


def dedupe(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The same rows with repeated chunks taken out of the text.

    ``counts`` names two further columns: lines before, and lines removed. Null and empty texts stay as they are. Rows
    that repeat both id and text are one document and are treated alike. A text that loses all its chunks becomes
    empty. Further columns are kept, whatever their names. An empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    key, rebuilt, gone_id, gone_key, removed = free_names(docs, "text_key", "rebuilt", "gone_id", "gone_key", "removed")
    gone = removals(docs, id_col, text_col).select(
        F.col("id").alias(gone_id), F.col("text_key").alias(gone_key), F.col("removed").alias(removed)
    )
    joined = docs.withColumn(key, F.xxhash64(text)).join(
        gone,
        F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)),
        "left",
    )
    done = joined.withColumn(rebuilt, without(text, F.col(removed)))
    columns = [
        (F.col(f"{rebuilt}.text").alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns
    ]
    if counts:
        columns += [F.col(f"{rebuilt}.lines").alias(counts[0]), F.col(f"{rebuilt}.removed_lines").alias(counts[1])]
    return done.select(*columns)


