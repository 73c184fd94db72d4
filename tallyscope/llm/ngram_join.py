"""Jaccard join of documents by their word shingles: a blocked product of the document by n-gram incidence.

1. Every text becomes its set of shingle hashes. Equal sets form one class; only classes go on.
2. A class can reach the wanted similarity only if it shares a gram of its prefix with the other one: the
   ``n - ceil(t n) + 1`` grams that come first in one order for the whole corpus (rare grams before frequent ones). Grams
   of one class only are dropped, the others are the blocks of the product.
3. Within a block, every class meets the block's smallest class first. Pairs whose sizes, places in the order or folded
   bit rows cannot give the overlap they need are discarded, the others get their exact overlap. Linked classes form
   groups.
4. Blocks in which two groups or more meet are multiplied out: every pair of classes of different groups passes through
   the same bounds inside the block's task, and only pairs that pass leave it, again for exact overlaps. A pair that is seen
   to share one of the grams just before in the order stays behind, since it leaves at its first shared gram. Blocks of many
   classes are cut into parts that meet pairwise. Pairs within one group add nothing to its components and are left
   out. So that a large group of near copies is one group by then, its crowded blocks are multiplied out first for the
   nearest partner of each class alone, in a few rounds; it costs stars and nearest partners, not a square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyscope.llm.components import components
from tallyscope.llm.tokens import free_names, give_back, in_small_batches, mix, shingle_sets
from tallyscope.session import discard, settle

SHINGLE, PERCENT = 5, 80
#: Slots of the table of frequent grams. It orders grams only; links do not depend on it.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Classes in one part of a block.
PART = 1024
#: Prefix grams before the shared one that are compared to find pairs which met in an earlier block.
BEFORE = 6
#: Classes from which on a block is crowded, and most rounds of nearest partners in crowded blocks.
CROWD, ROUNDS = 64, 3


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def frequent_slots(texts: DataFrame, size: int) -> np.ndarray:
    """Level (bits of the document count) of each slot of gram hashes, over all texts of column ``text``.

    A task counts its documents in every slot and reports the slots far above its mean; reports are summed. The
    result has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int32)
        for batch in batches:
            for grams in shingle_sets(batch.column(0), size):
                np.add.at(total, _slot(grams), 1)
        give_back()
        heavy = np.flatnonzero(total >= 8 + 2 * total.mean())
        yield pa.RecordBatch.from_arrays([pa.array(heavy), pa.array(total[heavy].astype(np.int64))], names=["slot", "docs"])

    level = np.zeros(SLOTS, dtype=np.uint8)
    summed = texts.select("text").mapInArrow(count, "slot long, docs long").groupBy("slot").agg(F.sum("docs").alias("docs"))
    found = summed.toArrow()
    level[found.column("slot").to_numpy()] = np.log2(found.column("docs").to_numpy()).astype(np.uint8) + 1
    return level


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Smallest shared count of sets with ``a`` and ``b`` members that reaches the similarity."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def folded_bits(grams: np.ndarray) -> bytes:
    """A row of bits, about as many as the set has members; each member turns one bit over.

    Bits in which two rows differ are at most the members the sets do not share.
    """
    width = max(64, 1 << (len(grams) - 1).bit_length())
    ones = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


@F.arrow_udf(T.LongType())
def least_difference(left: pa.Array, right: pa.Array) -> pa.Array:
    """A lower bound of the members that only one of two sets has, from their bit rows."""
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = (np.frombuffer(side.as_buffer(), dtype=np.uint8) for side in (a, b))
        size = min(len(x), len(y))
        out.append(int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()))
    return pa.array(out, type=pa.int64())


def _described(texts: DataFrame, size: int, percent: int, level: np.ndarray) -> DataFrame:
    """``set_id, n, bits, prefix`` of every text: class hash (null without words), set size, bit row, prefix grams in order."""
    shared = texts.sparkSession.sparkContext.broadcast(level)

    kind = T.StructType().add("set_id", T.LongType()).add("n", T.LongType()).add("bits", T.BinaryType())

    @F.arrow_udf(kind.add("prefix", T.ArrayType(T.LongType())))
    def describe(values: pa.Array) -> pa.Array:
        ids, sizes, rows, prefixes = [], [], [], []
        for grams in shingle_sets(values, size):
            n = len(grams)
            sizes.append(n)
            if not n:
                ids.append(None)
                rows.append(None)
                prefixes.append(np.empty(0, dtype=np.int64))
                continue
            whole = mix(grams)
            spread = np.array([whole.sum() + np.uint64(n), np.bitwise_xor.reduce(whole)], dtype=np.uint64)
            ids.append(int((mix(spread) * np.array([1, 0x9E3779B97F4A7C15], dtype=np.uint64)).sum().astype(np.int64)))
            rows.append(folded_bits(grams))
            order = np.lexsort((grams, shared.value[_slot(grams)]))
            prefixes.append(grams[order[: n - -(-percent * n // 100) + 1]].view(np.int64))
        flat = np.concatenate([*prefixes, np.empty(0, dtype=np.int64)])
        ends = np.cumsum([0, *map(len, prefixes)])
        return pa.StructArray.from_arrays(
            [
                pa.array(ids, type=pa.int64()),
                pa.array(sizes, type=pa.int64()),
                pa.array(rows, type=pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat)),
            ],
            names=["set_id", "n", "bits", "prefix"],
        )

    return texts.withColumn("described", describe("text")).select(
        *[c for c in texts.columns if c != "text"], "text", "described.*"
    )


def _gram_sets(size: int):
    @F.arrow_udf(T.BinaryType())
    def sets(values: pa.Array) -> pa.Array:
        return pa.array([grams.tobytes() for grams in shingle_sets(values, size)], type=pa.binary())

    return sets


@F.arrow_udf(T.LongType())
def overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    """Shared members of two sorted sets of 64-bit hashes."""
    out = []
    for a, b in zip(left, right, strict=True):
        x = np.frombuffer(a.as_buffer(), dtype=np.uint64)
        y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out.append(int(np.count_nonzero(y[at] == x)) if len(x) else 0)
    return pa.array(out, type=pa.int64())


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes, and places of the shared gram, allow the overlap they need."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    room = F.lit(1) + F.least(n_a - F.col("at_a") - 1, n_b - F.col("at_b") - 1) + F.least("at_a", "at_b")
    return pairs.filter(
        (F.lit(100) * F.least(n_a, n_b) >= F.lit(percent) * F.greatest(n_a, n_b))
        & (room >= least_overlap(n_a, n_b, percent))
    )


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bit rows leave room for the overlap they need."""
    left = classes.select(F.col("set_id").alias("a"), F.col("bits").alias("bits_a"))
    right = classes.select(F.col("set_id").alias("b"), F.col("bits").alias("bits_b"))
    bounded = pairs.join(left, "a").join(right, "b").withColumn("apart", least_difference("bits_a", "bits_b"))
    most = (F.col("n_a") + F.col("n_b") - F.col("apart")) / 2
    return bounded.filter(most >= least_overlap(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs that reach the similarity, by exact overlap."""
    left = sets.select(F.col("set_id").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("grams").alias("grams_b"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("shared", overlap("grams_a", "grams_b"))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return scored.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * union).select("a", "b")


def _fitting_rows(n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows pass the bounds of size and place, and the overlap each of them needs."""
    n_a, n_b, at_a, at_b = n[a], n[b], at[a], at[b]
    least = -(-percent * (n_a + n_b) // (100 + percent))
    # A pair leaves at the first gram its prefixes share: only later grams can add to the overlap.
    room = np.minimum(n_a - at_a, n_b - at_b)
    fits = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (room >= least)
    return fits, least


class BitRows:
    """Bit rows of one batch, grouped by width, to compare many pairs of rows at once."""

    def __init__(self, bits: pa.Array):
        offsets = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data = np.frombuffer(bits.buffers()[2] or b"", dtype=np.uint8)
        self.width = np.diff(offsets)
        self.place = np.zeros(len(bits), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.place[own] = np.arange(len(own))
            self.rows[width] = data[offsets[own][:, None] + np.arange(width)].view(np.uint64)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which each pair differs, the wider row folded to the other's width."""
        out = np.zeros(len(a), dtype=np.int64)
        widths = self.width[a] << 32 | self.width[b]
        for both in np.unique(widths).tolist():
            some = np.flatnonzero(widths == both)
            for at in range(0, len(some), 1 << 16):
                part = some[at : at + (1 << 16)]
                sides = [self.rows[w][self.place[side[part]]] for w, side in ((both >> 32, a), (both & 0xFFFFFFFF, b))]
                size = min(sides[0].shape[1], sides[1].shape[1])
                sides = [np.bitwise_xor.reduce(x.reshape(len(part), -1, size), axis=1) for x in sides]
                out[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
        return out


#: Pairs that are compared at once.
PAIRS = 1 << 17


def _met_before(before: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that share one of the grams before the block's gram; those leave at an earlier block."""
    met = np.zeros(len(a), dtype=bool)
    for mine in before.T:
        for other in before.T:
            met |= mine[a] == other[b]
    return met


def group_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of consecutive rows, groups of one size together."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == size]
        low, high = np.triu_indices(size, 1)
        step = max(1, PAIRS // len(low))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            yield (base + low).ravel(), (base + high).ravel()


def part_pairs(
    starts: np.ndarray,
    sizes: np.ndarray,
    n: np.ndarray,
    at: np.ndarray,
    root: np.ndarray,
    side: np.ndarray,
    bits: pa.Array,
    before: np.ndarray,
    percent: int,
    nearest: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that pass all bounds: of different roots, and of both sides where a group has two.

    ``at`` is the place of the shared gram in the order of each set, ``before`` has a row of the grams just before it.
    ``nearest``: of all these pairs, and those that met before, only the one of each row that may be the most similar.
    """
    rows = BitRows(bits)
    two_sides = np.zeros(len(n), dtype=bool)
    if len(starts):
        mixed = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
        two_sides[: int((starts + sizes).max())] = np.repeat(mixed, sizes)
    first, second, likeness = [], [], []
    for a, b in group_pairs(starts, sizes):
        keep = (root[a] != root[b]) & (~two_sides[a] | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        fits, least = _fitting_rows(n, at, a, b, percent)
        a, b, least = a[fits], b[fits], least[fits]
        if not nearest:
            fresh = ~_met_before(before, a, b)
            a, b, least = a[fresh], b[fresh], least[fresh]
        most = (n[a] + n[b] - rows.apart(a, b)) // 2
        passed = most >= least
        a, b, most = a[passed], b[passed], most[passed]
        if nearest:
            a, b, like = _nearest(np.concatenate([a, b]), np.concatenate([b, a]), np.tile(most / (n[a] + n[b] - most), 2))
            likeness.append(like)
        first.append(a)
        second.append(b)
    empty = np.empty(0, dtype=np.int64)
    a, b = np.concatenate([*first, empty]), np.concatenate([*second, empty])
    return (a, b) if not nearest else _nearest(a, b, np.concatenate([*likeness, empty]))[:2]


def _nearest(a: np.ndarray, b: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first pair of each ``a`` by likeness, the largest first."""
    order = np.lexsort((b, -like, a))
    chosen = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
    return a[chosen], b[chosen], like[chosen]


def _block_product(rows: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """``a, b, n_a, n_b`` from ``gram, part, other_part, side, set_id, n, at, root, bits`` and the ``BEFORE`` grams before.

    Tasks read their rows in order of the parts that meet; a part has a bounded number of rows, so a task holds one batch
    and one part.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def pairs_of(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            keys = [table.column(c).to_numpy() for c in ("gram", "part", "other_part")]
            change = np.flatnonzero(np.logical_or.reduce([key[1:] != key[:-1] for key in keys])) + 1
            cuts = np.concatenate([[0], change, [len(table)] if last else np.empty(0, dtype=np.int64)]).astype(np.int64)
            whole = table.slice(0, int(cuts[-1]))
            n, at, root, side, ids = (whole.column(c).to_numpy() for c in ("n", "at", "root", "side", "set_id"))
            bits = pa.concat_arrays(whole.column("bits").chunks) if len(whole) else pa.array([], type=pa.binary())
            before = np.stack([whole.column(f"before_{k}").to_numpy() for k in range(BEFORE)], axis=1)
            left, right = part_pairs(cuts[:-1], np.diff(cuts), n, at, root, side, bits, before, percent, nearest)
            columns = [pa.array(values) for values in (ids[left], ids[right], n[left], n[right])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b"]), table.slice(int(cuts[-1]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table])
            pairs, kept = pairs_of(table, False)
            yield pairs
        if kept is not None:
            yield pairs_of(kept, True)[0]
        give_back()

    place = ["gram", "part", "other_part"]
    dealt = rows.repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(multiply, "a long, b long, n_a long, n_b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, set_id, component_id, text_key, first``.

    Documents link when ``100 * shared >= percent * union`` of their shingle sets; ``component_id`` is the smallest id
    reachable by links, the own id included. A text that is null, empty or without words has no shingles and links with
    nothing. Equal sets have one ``set_id`` (a 64-bit hash; null without words). Rows with a null id take part in
    links; a component in which all ids are null has a null id. ``text_key`` is the text's hash, and ``first`` marks the
    row of each component that has the smallest id, then text hash (nulls last; every row without shingles; rows that
    repeat id and text are marked alike). Repeated rows give repeated rows; other columns are not carried; an empty
    table gives an empty result.
    """
    texts = in_small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    level = frequent_slots(texts, size)
    rows = settle(
        _described(texts, size, percent, level).select(
            "id", F.xxhash64("text").alias("text_key"), "set_id", "n", "bits", "prefix"
        )
    )
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key")
    classes = settle(
        rows.filter("set_id is not null")
        .groupBy("set_id")
        .agg(F.min(place).alias("one"), F.min("bits").alias("bits"), F.min("prefix").alias("prefix"))
        .select("set_id", "one", "one.id", "one.text_key", "bits", "prefix")
    )

    # Copies of a class repeat its entries; they are merged by the minimum and the distinct below.
    entries = rows.select("set_id", "n", F.posexplode("prefix").alias("at", "gram")).select(
        "gram", "set_id", "n", F.col("at").cast("long").alias("at")
    )
    blocks = (
        entries.groupBy("gram")
        .agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last"))
        .filter("pivot != last")
        .select("gram", "pivot")
    )
    met = settle(entries.join(blocks, "gram").distinct())

    def exact_links(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs; the sets of their classes are made again from one text each."""
        open_pairs = settle(pairs)
        needed = open_pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        wanted = needed.join(classes.select("set_id", "text_key", "id"), "set_id").alias("wanted")
        keyed = texts.withColumn("text_key", F.xxhash64("text")).alias("keyed")
        found = keyed.join(
            wanted,
            (F.col("keyed.text_key") == F.col("wanted.text_key")) & F.col("keyed.id").eqNullSafe(F.col("wanted.id")),
        )
        sets = settle(found.select("set_id", _gram_sets(size)("text").alias("grams")).dropDuplicates(["set_id"]))
        found = settle(_linked(open_pairs, sets, percent))
        discard(open_pairs, sets)
        return found

    stars = (
        met.filter("set_id != pivot")
        .select("gram", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("pivot").alias("b"))
        .join(
            met.filter("set_id = pivot").select("gram", F.col("n").alias("n_b"), F.col("at").alias("at_b")).distinct(),
            "gram",
        )
    )
    stars = _fitting(stars, percent).select("a", "b", "n_a", "n_b").distinct()
    links = exact_links(_possible(stars, classes, percent))
    groups = settle(components(links))

    def open_rows(groups: DataFrame, least: int) -> DataFrame:
        """Rows for the product, of the blocks of ``least`` classes or more in which two groups meet."""
        grouped = met.join(groups, F.col("set_id") == F.col("node"), "left").select(
            "gram", "set_id", "n", "at", F.coalesce("root", "set_id").alias("root")
        )
        mixed = (
            grouped.groupBy("gram")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("met"))
            .filter((F.col("low") != F.col("high")) & (F.col("met") >= least))
            .select("gram", F.ceil(F.col("met") / PART).alias("parts"))
        )
        own = F.pmod(F.xxhash64("set_id"), F.col("parts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        return (
            grouped.join(mixed, "gram")
            .select("gram", "set_id", "n", "at", "root", own.alias("own"), other.alias("other"))
            .select(
                "gram",
                F.least("own", "other").alias("part"),
                F.greatest("own", "other").alias("other_part"),
                F.col("own").alias("side"),
                "set_id",
                "n",
                "at",
                "root",
            )
        )

    def product(rows: DataFrame, nearest: bool = False) -> DataFrame:
        # Where there are fewer grams before, the class's own hash stands in, which no other class has.
        before = [F.coalesce(F.get("prefix", F.col("at").cast("int") - k - 1), "set_id").alias(f"before_{k}") for k in range(BEFORE)]
        with_bits = rows.join(classes.select("set_id", "bits", "prefix"), "set_id").select(*rows.columns, "bits", *before)
        return _block_product(with_bits, percent, nearest).distinct()

    for _ in range(ROUNDS):
        crowded = settle(open_rows(groups, CROWD))
        if crowded.isEmpty():
            break
        more = exact_links(product(crowded, nearest=True))
        discard(crowded)
        if more.isEmpty():
            break
        links = links.unionAll(more)
        groups = settle(components(links))

    whole = components(links.unionAll(exact_links(product(open_rows(groups, 2)))))

    rooted = settle(
        classes.join(whole, F.col("set_id") == F.col("node"), "left").select(
            "set_id", "one", F.coalesce("root", "set_id").alias("root")
        )
    )
    discard(classes, met)
    smallest = rooted.groupBy("root").agg(F.min("one").alias("one"))
    answer = rooted.select("set_id", "root").join(smallest, "root").select("set_id", "one")
    alone = F.col("set_id").isNull()
    return rows.select("id", "n", "set_id", "text_key").join(answer, "set_id", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "set_id",
        F.when(alone, F.col("id")).otherwise(F.col("one.id")).alias("component_id"),
        "text_key",
        (alone | (F.col("id").eqNullSafe(F.col("one.id")) & (F.col("text_key") == F.col("one.text_key")))).alias("first"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """The rows of ``docs`` that are first of their component, with all their columns; one row for each id and text."""
    key, kept_id, kept_key = free_names(docs, "text_key", "kept_id", "kept_key")
    judged = near_duplicates(docs, id_col, text_col, **bounds).filter("first")
    kept = judged.select(F.col(f"`{id_col}`").alias(kept_id), F.col("text_key").alias(kept_key))
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_col, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
