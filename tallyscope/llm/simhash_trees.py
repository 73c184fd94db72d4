"""Near copies by SimHash fingerprints, found with vantage-point trees.

Every level of the tree has a vantage point and eight of the 64 bits. The branch of a fingerprint is its Hamming
distance to the vantage point over these bits. The bits of different levels are disjoint, so for two fingerprints the
differences of their branches, summed over the levels, are at most their Hamming distance: a search with radius 3 enters
a branch only while that sum is at most 3, and no pair is lost.

The upper levels deal distinct fingerprints to shards. A fingerprint is kept in its own shard and asked in every shard
that the bound does not exclude, in one direction only, so each pair meets once. Shards with too many fingerprints are
opened by a further level. The lower levels are searched inside a task over a sorted array of branch codes, for many
questions at once. A shard that stays large with all levels used up is dealt out as a grid of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tallyscope.llm.components import components
from tallyscope.llm.tokens import give_back, in_small_batches
from tallyscope.session import settle

SHINGLE = 3
SEED = 42
RADIUS = 3
LEVELS, BITS = 8, 8
#: Levels that always deal fingerprints to shards; fingerprints and questions of one shard at most.
FIRST_LEVELS = 2
SHARD_ROWS, SHARD_QUESTIONS = 1 << 16, 1 << 18
#: Questions searched at once, branch sizes that are compared whole, and pairs compared at once.
ASKED_AT_ONCE, LEAF, PAIRS_AT_ONCE = 2048, 24, 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HASHED_AT_ONCE = 1 << 15
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COUNTED = np.arange(8) * 256


def fingerprint(text: bytes | None) -> int:
    """SimHash of the 3-word shingles of a text, repeats included; 0 for a text without words."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    span = min(SHINGLE, len(words)) - 1
    begins, ends = begins[: len(words) - span], ends[span:]
    seeded = partial(xxh64_intdigest, seed=SEED)
    seen = np.zeros(8 * 256, dtype=np.int64)
    for at in range(0, len(begins), _HASHED_AT_ONCE):
        cuts = map(slice, begins[at : at + _HASHED_AT_ONCE].tolist(), ends[at : at + _HASHED_AT_ONCE].tolist())
        hashes = np.fromiter(map(seeded, map(line.__getitem__, cuts)), dtype="<u8")
        seen += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COUNTED).ravel(), minlength=8 * 256)
    ones = seen.reshape(8, 256) @ _BIT_OF_BYTE
    return int(np.packbits(2 * ones.ravel() > len(begins), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
    give_back()


# --- shards ---------------------------------------------------------------------------------------


def _vantage_points(prints: DataFrame) -> int:
    """The vantage points of all levels, eight bits each: those of the fingerprint with the least hash."""
    return prints.agg(F.min_by("print", F.xxhash64("print", F.lit(LEVELS)))).first()[0]


def _branch(level: int, vantage: int) -> Column:
    bits = ((1 << BITS) - 1) << (level * BITS)
    bits -= (bits >> 63) << 64  # as a signed number
    return F.bit_count(F.col("print").bitwiseXOR(F.lit(vantage)).bitwiseAND(F.lit(bits)))


def _opened(rows: DataFrame, level: int, vantage: int) -> DataFrame:
    """Rows ``path, print, spare, own`` of the next level.

    A kept row is asked in the branches above its own; a question, which already left the branches of its
    fingerprint, goes both ways. ``spare`` is what is left of the radius.
    """
    here = rows.withColumn("branch", _branch(level, vantage))
    step = F.explode(F.sequence(F.when(F.col("own"), 0).otherwise(-F.col("spare")), F.col("spare"))).alias("step")
    branch = F.col("branch") + F.col("step")
    return here.select("*", step).filter(branch.between(0, BITS)).select(
        (F.col("path") * 16 + branch).alias("path"),
        "print",
        (F.col("spare") - F.abs("step")).cast("int").alias("spare"),
        (F.col("own") & (F.col("step") == 0)).alias("own"),
    )


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of shards that keep at least one fingerprint, with the numbers of kept rows and questions."""
    sizes = rows.groupBy("path").agg(F.count_if("own").alias("kept"), F.count_if(~F.col("own")).alias("asked"))
    return rows.join(sizes.filter("kept > 0"), "path")


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """``level, path, print, spare, own, kept, asked``: fingerprints and questions of every shard."""
    vantage = _vantage_points(prints)
    rows = prints.select(
        F.lit(0).cast("long").alias("path"), "print", F.lit(radius).alias("spare"), F.lit(True).alias("own")
    )
    closed = None
    for level in range(LEVELS):
        rows = _opened(rows, level, vantage)
        if level + 1 < FIRST_LEVELS:
            continue
        sized = settle(_sized(rows)).withColumn("level", F.lit(level + 1))
        large = (F.col("kept") > SHARD_ROWS) & F.lit(level + 1 < LEVELS)
        closed = sized.filter(~large) if closed is None else closed.unionByName(sized.filter(~large))
        rows = sized.filter(large).select("path", "print", "spare", "own")
        if rows.isEmpty():
            break
    return closed.withColumn("vantage", F.lit(vantage))


def _dealt(shards: DataFrame, radius: int) -> DataFrame:
    """Parts of bounded size of each shard: ``part`` of the kept rows by ``side`` of the questions.

    Kept rows stand in every side of their part, and are questions to the parts after it.
    """
    parts = F.ceil(F.col("kept") / SHARD_ROWS)
    # Kept rows of a divided shard ask its other parts.
    questions = F.col("asked") + F.when(parts > 1, F.col("kept")).otherwise(0)
    sides = F.greatest(F.lit(1), F.ceil(questions / SHARD_QUESTIONS))
    part = F.pmod(F.xxhash64("print", F.lit(1)), F.col("parts"))
    side = F.pmod(F.xxhash64("print", F.lit(2)), F.col("sides"))

    def cell(part: Column, side: Column, own: bool, spare: Column) -> Column:
        return F.struct(part.alias("part"), side.alias("side"), F.lit(own).alias("own"), spare.alias("spare"))

    def each(count: Column, of) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), count), lambda k: k < count), of)

    kept = F.concat(
        each(F.col("sides"), lambda k: cell(part, k, True, F.col("spare"))),
        F.filter(
            each(F.col("parts"), lambda k: cell(k, side, False, F.lit(radius))), lambda c: c["part"] > part
        ),
    )
    asked = each(F.col("parts"), lambda k: cell(k, side, False, F.col("spare")))
    return (
        shards.withColumn("parts", parts)
        .withColumn("sides", sides)
        .select("level", "path", "print", "vantage", F.explode(F.when(F.col("own"), kept).otherwise(asked)).alias("cell"))
        .select("level", "path", "print", "vantage", "cell.*")
    )


# --- search inside a shard ------------------------------------------------------------------------


def _codes(prints: np.ndarray, vantage: int, level: int) -> np.ndarray:
    """Branches of all levels from ``level`` on as one number, the upper level first."""
    apart = np.bitwise_count((prints ^ np.uint64(vantage)).view(np.uint8).reshape(-1, 8)).astype(np.uint64)
    code = np.zeros(len(prints), dtype=np.uint64)
    for k in range(level, LEVELS):
        code = code * np.uint64(16) + apart[:, k]
    return code


def _ranges(asked: np.ndarray, spare: np.ndarray, codes: np.ndarray, levels: int) -> tuple[np.ndarray, ...]:
    """Question and bounds of every run of ``codes`` (sorted) that the triangle bounds do not exclude."""
    who, low, high = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.full(len(asked), len(codes))
    prefix, left = np.zeros(len(asked), np.uint64), spare.astype(np.int64)
    done = []
    for level in range(levels):
        small = high - low <= LEAF
        done.append((who[small], low[small], high[small]))
        who, low, high, prefix, left = (x[~small] for x in (who, low, high, prefix, left))
        if not len(who):
            break
        shift = np.uint64(4 * (levels - 1 - level))
        branch = ((asked[who] >> shift) & np.uint64(15)).astype(np.int64)
        found = []
        for step in range(-RADIUS, RADIUS + 1):
            goes = np.flatnonzero((left >= abs(step)) & (branch + step >= 0) & (branch + step <= BITS))
            child = prefix[goes] * np.uint64(16) + (branch[goes] + step).astype(np.uint64)
            a = np.searchsorted(codes, child << shift)
            b = np.searchsorted(codes, (child + np.uint64(1)) << shift)
            some = b > a
            found.append((who[goes][some], a[some], b[some], child[some], left[goes][some] - abs(step)))
        who, low, high, prefix, left = (np.concatenate(x) for x in zip(*found, strict=True))
    done.append((who, low, high))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


class _Groups:
    """Union-find over positions; ``root`` is flat after every :meth:`join`."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.maximum(a, b)[apart], np.minimum(a, b)[apart]], axis=1), axis=0)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
        moved = np.arange(len(self.root))
        for x in list(parent):
            moved[x] = top(x)
        self.root = moved[self.root]


def _linked(prints: np.ndarray, own: np.ndarray, spare: np.ndarray, vantage: int, level: int, inner: bool) -> np.ndarray:
    """Root position of every row, where a link is a kept and another row at most ``RADIUS`` bits apart.

    ``inner``: kept rows are linked with each other, too.
    """
    codes = _codes(prints, vantage, level)
    kept = np.flatnonzero(own)
    kept = kept[np.argsort(codes[kept], kind="stable")]
    tree, rank = codes[kept], np.full(len(prints), -1)
    rank[kept] = np.arange(len(kept))
    groups = _Groups(len(prints))
    questions = np.arange(len(prints)) if inner else np.flatnonzero(~own)
    for at in range(0, len(questions), ASKED_AT_ONCE):
        some = questions[at : at + ASKED_AT_ONCE]
        who, low, high = _ranges(codes[some], spare[some], tree, LEVELS - level)
        # A kept row looks only at those after it.
        low = np.maximum(low, rank[some][who] + 1)
        who, low, high = (x[high > low] for x in (who, low, high))
        ends = np.cumsum(high - low)
        first = 0
        while first < len(who):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
            many = (high - low)[first:last]
            place = np.arange(many.sum()) + np.repeat(low[first:last] - (np.cumsum(many) - many), many)
            a, b = some[np.repeat(who[first:last], many)], kept[place]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
            groups.join(a[near], b[near])
            first = last
    return groups.root


def _shard_links(table: pa.Table) -> pa.Table:
    """Links ``a, b`` of every row of a shard to the root of its group."""
    signed = table["print"].to_numpy()
    root = _linked(
        signed.view(np.uint64),
        table["own"].to_numpy(),
        table["spare"].to_numpy(),
        table["vantage"][0].as_py() & 0xFFFF_FFFF_FFFF_FFFF,
        table["level"][0].as_py(),
        table["side"][0].as_py() == 0,
    )
    moved = np.flatnonzero(root != np.arange(len(root)))
    links = pa.table({"a": signed[moved], "b": signed[root[moved]]})
    give_back()
    return links


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect all distinct ``print`` values at most ``radius`` (3 at most) bits apart."""
    cells = _dealt(_shards(prints, radius), radius)
    return cells.groupBy("level", "path", "part", "side").applyInArrow(_shard_links, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id, text``; other columns are ignored).

    Documents whose fingerprints differ in at most three bits are linked; ``component_id`` is the smallest ``doc_id`` that
    links lead to. A null, empty or blank text has fingerprint 0 and is linked like any other. Rows without ``doc_id`` are
    rows of their fingerprint's component; the smallest id is taken of those that are known, null if there is none.
    Repeated rows stay. Exact copies share one fingerprint and are compared once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = settle(in_small_batches(texts).mapInArrow(_fingerprints, "doc_id long, print long"))
    distinct = settle(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    if distinct.isEmpty():
        rooted = distinct.withColumn("root", F.col("print"))
    else:
        reached = components(settle(links(distinct)))
        rooted = distinct.join(reached, F.col("print") == F.col("node"), "left").select(
            "print", "least", F.coalesce("root", "print").alias("root")
        )
    rooted = settle(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
