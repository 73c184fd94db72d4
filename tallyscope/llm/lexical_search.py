"""Ranked lexical search turned round: the items are the index, the documents stream through it.

The terms of all items form an inverted index that every task holds. A document is cut into terms once; what it has in
common with the index is kept as a row of term numbers and counts. A second pass looks the postings of these terms up,
adds the scores of all items for a block of documents at a time, and keeps one heap of the best documents per item and
task. Heaps are merged in two rounds, so that no group holds the heaps of all tasks.

The index is broadcast in blocks of items: a block has at most ``2 * BLOCK_POSTINGS`` postings, or is one item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyscope.llm.tokens import give_back, in_small_batches
from tallyscope.session import settle

TOP = 20
#: Postings (distinct terms of an item) of one broadcast block, on average at most.
BLOCK_POSTINGS = 1 << 18
#: Postings, and cells of documents times items, that are added up at once.
ADDED_AT_ONCE, CELLS_AT_ONCE = 1 << 20, 1 << 21
#: Tasks whose heaps are merged in one group of the first round.
TASKS_PER_MERGE = 256

_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; A-Z in lower case."""
    return text.translate(_BYTES).split() if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, terms, times = [], [], []
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(terms_of(text))
            numbers += [number] * len(found)
            terms += found.keys()
            times += found.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())],
            names=["item", "term", "times"],
        )


def _matched(vocabulary):
    """Length of every document, and number and count of each of its terms that the index has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            lengths, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(filter(numbers.__contains__, words))
                lengths.append(len(words))
                terms += map(numbers.__getitem__, found)
                counts += found.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )
        give_back()

    return run


class _Heaps:
    """The best documents of every item: score, then a known id before none, then the smaller id."""

    def __init__(self, items: int, top: int):
        self.top, self.rows = top, [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)

    def add(self, board: np.ndarray, ids: list[int | None]) -> None:
        """``board``: scores of documents (rows) for items (columns)."""
        least = self.least
        if len(board) > self.top:
            at = len(board) - self.top
            least = np.maximum(least, np.partition(board, at, axis=0)[at])
        docs, items = np.nonzero(board >= least)
        for d, i, score in zip(docs.tolist(), items.tolist(), board[docs, items].tolist(), strict=True):
            heap, row = self.rows[i], (score, ids[d] is not None, -(ids[d] or 0))
            if len(heap) < self.top:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]


def _ranked(index, n_docs: int, n_terms: int, top: int):
    """Best documents of each item among those of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, item, times, weight, numbers = index.value
        width = len(numbers)
        heaps = _Heaps(width, top)
        most_docs = max(1, CELLS_AT_ONCE // width)
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            terms = lists.values.to_numpy()[: ends[-1]]
            counts = batch.column(3).values.to_numpy()[: ends[-1]].astype(np.int64)
            ids = batch.column(0).to_pylist()
            length = batch.column(1).to_numpy()
            m = 100 - 25 + 25 * length * n_docs // n_terms
            own = np.repeat(np.arange(len(ids)), np.diff(ends))
            worth = weight[terms] * (1_000_000_000 * counts // (1000 * counts + 12 * m[own]))
            reach = start[terms + 1] - start[terms]
            upto = np.concatenate([[0], np.cumsum(reach)])[ends]
            first = 0
            while first < len(ids):
                last = int(np.searchsorted(upto, upto[first] + ADDED_AT_ONCE, side="right")) - 1
                last = min(max(last, first + 1), first + most_docs, len(ids))
                a, b = ends[first], ends[last]
                many = reach[a:b]
                place = np.arange(many.sum()) + np.repeat(start[terms[a:b]] - (np.cumsum(many) - many), many)
                board = np.zeros((last - first, width), dtype=np.int64)
                cells = np.repeat((own[a:b] - first) * width, many) + item[place]
                np.add.at(board.reshape(-1), cells, np.repeat(worth[a:b], many) * times[place])
                heaps.add(board, ids[first:last])
                first = last
        found = [(numbers[i], -r[2] if r[1] else None, r[0]) for i, heap in enumerate(heaps.rows) for r in heap]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(c, pa.int64()) for c in columns],
                pa.array([TaskContext.get().partitionId()] * len(found), pa.int64()),
            ],
            names=["item", "doc_id", "score", "task"],
        )
        give_back()

    return run


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(postings: DataFrame) -> tuple[int, list[int]]:
    """How many blocks the items are dealt to by hash, and which of them hold any."""
    total = postings.count()
    parts = max(1, math.ceil(total / BLOCK_POSTINGS))
    while total:
        sizes = (
            postings.groupBy(F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"))
            .agg(F.count("*").alias("n"), F.min("item").alias("a"), F.max("item").alias("b"))
            .collect()
        )
        if all(r["n"] <= 2 * BLOCK_POSTINGS or r["a"] == r["b"] for r in sizes):
            return parts, [r["part"] for r in sizes]
        parts *= 2
    return parts, []


def _search_block(spark: SparkSession, texts: DataFrame, postings: DataFrame, top: int) -> DataFrame:
    """Merged heaps ``item, doc_id, score, rank`` of one block of items."""
    context = spark.sparkContext
    block = postings.toArrow()
    words = sorted(set(block["term"].to_pylist()))
    number = {word: k for k, word in enumerate(words)}
    vocabulary = context.broadcast(number)
    kept = settle(
        in_small_batches(texts).mapInArrow(_matched(vocabulary), "doc_id long, n long, terms array<int>, counts array<int>")
    )
    sums = kept.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 0
    holding = kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = np.zeros(len(words), dtype=np.int64)
    for term, df in holding.toPandas().itertuples(index=False):
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    items = np.unique(block["item"].to_numpy())
    of_term = np.array([number[w] for w in block["term"].to_pylist()], dtype=np.int64)
    order = np.argsort(of_term, kind="stable")
    index = context.broadcast(
        (
            np.searchsorted(of_term[order], np.arange(len(words) + 1)),
            np.searchsorted(items, block["item"].to_numpy()[order]),
            block["times"].to_numpy()[order],
            weight,
            items.tolist(),
        )
    )
    hits = kept.filter(F.size("terms") > 0).mapInArrow(
        _ranked(index, n_docs, max(n_terms, 1), top), "item long, doc_id long, score long, task long"
    )
    early = _best(hits.withColumn("part", F.expr(f"task div {TASKS_PER_MERGE}")), ["item", "part"], top)
    return settle(_best(early.select("item", "doc_id", "score"), ["item"], top))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the documents with the highest scores above 0 for every item.

    ``docs`` needs ``doc_id, text``, ``items`` needs ``item_id, text``; other columns are ignored. With N documents that
    have a term, L terms in all of them, and df documents that hold a term, a term weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document of n terms that holds it tf times has
    ``weight * (10**9 * tf div (1000 * tf + 12 * m))`` with ``m = 75 + 25 * n * N div L``, summed over the item's terms
    with repeats. Null and empty texts have no terms: such documents are not counted, such items have no rows. Equal
    scores rank by ``doc_id``, unknown ids last. Every row of ``docs`` is a document, so a repeated row is ranked again;
    equal rows of ``items`` are one item, and one ``item_id`` with several texts is ranked once for each.
    """
    spark = docs.sparkSession
    named = settle(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    postings = settle(
        in_small_batches(named.select("item", F.col("text").cast("binary"))).mapInArrow(
            _item_terms, "item long, term binary, times long"
        )
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts, used = _blocks(postings)
    found = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    for part in used:
        own = postings.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        found = found.unionByName(_search_block(spark, texts, own, top))
    return found.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
