"""Nearest neighbours by inner product through multiprobe p-stable hashing.

Largest inner product becomes smallest Euclidean distance by one more coordinate, ``sqrt(M^2 - |x|^2)`` for rows and 0 for
queries, which are scaled to the largest norm M. Each table hashes with a few Gaussian projections cut into cells of equal
width. A query visits the cells in order of their estimated success: the chance that a point at the distance of a
typical neighbour falls into them. The cells of all tables give candidates, whose inner products are computed exactly.

The number of visited cells per table is fitted on a bounded sample of queries with exact neighbours, to a
wanted recall. That fits typical queries; a query that finds fewer rows than asked for, or whose last found neighbour lies so
far off that its cells hold a point at that distance with a chance below the wanted recall, is compared with all rows
instead, block by block. Every distinct vector is indexed once; equal vectors are expanded afterwards. Large cells are split into
blocks of rows and of queries, so no cell is one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tallyscope.session import settle

TABLES = 2
#: Cell width in units of a projection's spread.
WIDTH = 1.5
#: Queries whose exact neighbours fit the number of visited cells, and the recall that is aimed at.
SAMPLE, RECALL = 64, 0.96
#: Rows, and queries, of one block of a cell.
ROW_BLOCK, QUERY_BLOCK = 4096, 512
#: Queries of a block that meets all rows.
WHOLE_QUERY_BLOCK = 8192

_CELLS = pa.list_(pa.struct([("table", pa.int32()), ("cell", pa.int64())]))


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, flat[starts[own][:, None] + np.arange(dim)]


class Hashing:
    """Projections and cells of all tables. ``functions`` projections per table, for vectors of norm up to ``norm``."""

    def __init__(self, functions: int, norm: float, seed: int = 5):
        self.functions, self.norm, self.seed = functions, norm, seed
        self.width = WIDTH * norm
        self.near = norm
        self.probes = 1
        #: Least and greatest cell that rows have, per dimension: (tables, functions).
        self.range: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _projected(self, points: np.ndarray) -> np.ndarray:
        """(tables, rows, functions), in cells. ``points`` have the further coordinate already."""
        dim = points.shape[1]
        rng = np.random.default_rng((self.seed, dim))
        directions = rng.normal(size=(TABLES, dim, self.functions))
        shifts = rng.uniform(0, 1, (TABLES, 1, self.functions))
        return np.stack([points @ directions[t] / self.width + shifts[t] for t in range(TABLES)])

    def rows(self, matrix: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (matrix * matrix).sum(axis=1), 0))
        return self._projected(np.concatenate([matrix, rest[:, None]], axis=1))

    def queries(self, matrix: np.ndarray) -> np.ndarray:
        scale = self.norm / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return self._projected(np.concatenate([matrix * scale, np.zeros((len(matrix), 1))], axis=1))

    def visited(self, dim: int, table: int, place: np.ndarray, probes: int) -> np.ndarray:
        """(probes, functions): cells of one table in falling order of estimated success.

        The best sums of the first functions are kept while functions are added one by one; a sum outside the best ones
        cannot belong to the best totals.
        """
        low, high = (bound[table] for bound in self.range[dim])
        cells, score = np.zeros((1, 0), dtype=np.int64), np.zeros(1)
        for k in range(self.functions):
            options = np.arange(low[k], high[k] + 1)
            edges = np.append(options, options[-1] + 1) - place[k]
            chance = np.diff([math.erf(e * self.width / (self.near * math.sqrt(2))) for e in edges])
            total = (score[:, None] + np.log(np.maximum(chance, 1e-300))[None, :]).ravel()
            best = np.argsort(-total, kind="stable")[:probes]
            cells = np.concatenate([cells[best // len(options)], options[best % len(options)][:, None]], axis=1)
            score = total[best]
        return cells


    def covered(self, vector: np.ndarray, score: float) -> float:
        """Chance that a row with this inner product lies in a visited cell of some table."""
        dim, size = len(vector), float(np.sqrt((vector * vector).sum()))
        apart = max(math.sqrt(max(2 * self.norm**2 - 2 * score * self.norm / size, 0.0)), 1e-3 * self.norm)
        missed = 1.0
        for table, place in enumerate(self.queries(vector[None, :])[:, 0]):
            low, high = (bound[table] for bound in self.range[dim])
            cells = self.visited(dim, table, place, self.probes)
            chance = np.ones(len(cells))
            for k in range(self.functions):
                edges = np.arange(low[k], high[k] + 2) - place[k]
                own = np.diff([math.erf(e * self.width / (apart * math.sqrt(2))) for e in edges])
                # Cells without any row hold no neighbour.
                chance *= own[cells[:, k] - low[k]] / max(own.sum(), 1e-300)
            missed *= max(0.0, 1 - chance.sum())
        return 1 - missed


def _key(dim: int, table: int, cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of every cell; a collision only adds candidates."""
    with np.errstate(over="ignore"):
        value = np.full(len(cells), dim * TABLES + table + 1, dtype=np.uint64)
        for column in cells.T:
            value = (value ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return value.view(np.int64)


def _keyed(hashing: Hashing, cells_of: Callable[[Hashing, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]):
    @F.arrow_udf(from_arrow_type(_CELLS))
    def keys(vectors: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(vectors))]
        for own, matrix in _rows(vectors):
            for table, row, values in cells_of(hashing, matrix):
                out[own[row]] += [{"table": table, "cell": int(v)} for v in values.tolist()]
        return pa.array(out, type=_CELLS)

    return keys


def _row_cells(hashing: Hashing, matrix: np.ndarray):
    dim = matrix.shape[1]
    for table, places in enumerate(hashing.rows(matrix)):
        for row, value in enumerate(_key(dim, table, np.floor(places).astype(np.int64))):
            yield table, row, np.array([value])


def _query_cells(hashing: Hashing, matrix: np.ndarray):
    dim = matrix.shape[1]
    if dim not in hashing.range:
        return
    for table, places in enumerate(hashing.queries(matrix)):
        for row, place in enumerate(places):
            yield table, row, _key(dim, table, hashing.visited(dim, table, place, hashing.probes))


def _covering(hashing: Hashing):
    @F.arrow_udf("double")
    def cover(vectors: pa.Array, scores: pa.Array) -> pa.Array:
        """Column function: ``hashing.covered`` of the query and the inner product of its last found row."""
        pairs = zip(vectors.to_pylist(), scores.to_pylist(), strict=True)
        return pa.array([0.0 if s is None else hashing.covered(np.array(v), s) for v, s in pairs], type=pa.float64())

    return cover


def _bounds(reps: DataFrame, hashing: Hashing) -> None:
    """Fill ``hashing.range`` from all rows: one row per task and dimension."""

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, matrix in _rows(batch.column(0)):
                cells = np.floor(hashing.rows(matrix)).astype(np.int64).reshape(TABLES, len(matrix), -1)
                now = [cells.min(axis=1), cells.max(axis=1)]
                was = seen.get(matrix.shape[1], now)
                seen[matrix.shape[1]] = [np.minimum(was[0], now[0]), np.maximum(was[1], now[1])]
        rows = [
            {"dim": dim, "place": k, "low": int(a), "high": int(b)}
            for dim, (low, high) in seen.items()
            for k, (a, b) in enumerate(zip(low.ravel(), high.ravel(), strict=True))
        ]
        yield pa.RecordBatch.from_pylist(
            rows, schema=pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
        )

    found = reps.select("vec").mapInArrow(extent, "dim int, place int, low long, high long")
    shape = (TABLES, hashing.functions)
    for row in found.groupBy("dim", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low, high = hashing.range.setdefault(row.dim, (np.zeros(shape, dtype=int), np.zeros(shape, dtype=int)))
        low.flat[row.place], high.flat[row.place] = row.low, row.high


def best_rows(queries: np.ndarray, rows: np.ndarray, reps: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row numbers and inner products of the ``top`` best rows of each query; ties go to the smaller ``reps``."""
    top = min(top, len(rows))
    longest = np.sqrt((rows * rows).sum(axis=1).max())
    out = []
    for first in range(0, len(queries), QUERY_BLOCK):
        part = queries[first : first + QUERY_BLOCK]
        products = part @ rows.T
        # Products and inner() may differ in the last bits: rows that close to the cut stay until they are rescored.
        margin = 1e-12 * rows.shape[1] * longest * np.sqrt((part * part).sum(axis=1))
        cut = -np.partition(-products, top - 1, axis=1)[:, top - 1] - margin
        q, r = np.nonzero(products >= cut[:, None])
        steps = range(0, len(q), 1 << 16)
        scores = np.concatenate([inner(part[q[k : k + (1 << 16)]], rows[r[k : k + (1 << 16)]]) for k in steps])
        order = np.lexsort((reps[r], -scores, q))
        q, r, scores = q[order], r[order], scores[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < top
        out.append((q[kept] + first, r[kept], scores[kept]))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, in an order that does not depend on the block."""
    return (left * right).sum(axis=1)


def _exact(reps: DataFrame, sample: list[tuple[int, np.ndarray]], top: int) -> pd.DataFrame:
    """``query, rep, vec``: exact neighbours of the sampled queries among all rows."""
    matrix: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in {len(v) for _, v in sample}:
        own = [(i, v) for i, v in sample if len(v) == dim]
        matrix[dim] = ([i for i, _ in own], np.stack([v for _, v in own]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, rows in _rows(batch.column(1)):
                if rows.shape[1] in matrix:
                    names, queries = matrix[rows.shape[1]]
                    here = batch.column(0).to_numpy()[own]
                    q, r, scores = best_rows(queries, rows, here, top + 1)
                    reps_here = here[r]
                    names = np.array(names)[q]
                    keep = names != reps_here
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[keep]),
                            pa.array(reps_here[keep]),
                            pa.array(scores[keep]),
                            pa.array(list(rows[r][keep]), type=pa.list_(pa.float64())),
                        ],
                        names=["query", "rep", "score", "vec"],
                    )

    found = reps.select("rep", "vec").mapInArrow(search, "query long, rep long, score double, vec array<double>")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= top).select("query", "vec").toPandas()


def fitted(reps: DataFrame, queries: DataFrame, top: int, recall: float = RECALL) -> Hashing:
    """Hashing for all rows of ``reps``, with as many probes as the sampled queries need."""
    facts = reps.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))
    n, norm = facts.first()
    cells = 4 * max(n, 1) ** (1 / 3)
    hashing = Hashing(max(1, round(math.log(cells) / math.log(4.5))), norm or 1.0)
    if not n:
        return hashing
    # Projections of unit Gaussians spread as much as the vectors are long; the width follows the largest norm.
    _bounds(reps, hashing)
    drawn = queries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    sample = [(row.rep, np.array(row.vec, dtype=np.float64)) for row in drawn]
    truth = _exact(reps, sample, top) if sample else None
    if truth is None or truth.empty:
        return hashing
    vectors = dict(sample)
    apart = []
    for query, vec in zip(truth["query"], truth["vec"], strict=True):
        q, x = vectors[query], np.asarray(vec)
        q = q * norm / np.linalg.norm(q)
        apart.append(math.sqrt(max(2 * norm**2 - 2 * float(q @ x), 0.0)))
    hashing.near = max(float(np.median(apart)), 1e-3 * norm)
    needed = []
    for query, group in truth.groupby("query"):
        q = vectors[query][None, :]
        rows = np.stack([np.asarray(v) for v in group["vec"]])
        least = np.full(len(rows), np.iinfo(np.int64).max)
        dim = q.shape[1]
        low, high = hashing.range[dim]
        for table in range(TABLES):
            whole = int(np.prod((high[table] - low[table] + 1).astype(float)))
            order = _key(dim, table, hashing.visited(dim, table, hashing.queries(q)[table][0], whole))
            rank = {int(v): k + 1 for k, v in reversed(list(enumerate(order.tolist())))}
            own = _key(dim, table, np.floor(hashing.rows(rows)[table]).astype(np.int64))
            least = np.minimum(least, [rank[int(v)] for v in own])
        needed += least.tolist()
    hashing.probes = int(np.sort(needed)[max(0, math.ceil(recall * len(needed)) - 1)])
    return hashing


def _compared(indexed: DataFrame, probed: DataFrame, top: int, query_block: int) -> DataFrame:
    """``query, rep, score``: the best rows of each query in every block of its cells."""
    cell = ["table", "cell"]
    sizes = settle(
        indexed.groupBy(cell).agg(F.count("*").alias("n_rows"))
        .join(probed.groupBy(cell).agg(F.count("*").alias("n_queries")), cell)
        .select(*cell, F.ceil(F.col("n_rows") / ROW_BLOCK).alias("row_blocks"), F.ceil(F.col("n_queries") / query_block).alias("query_blocks"))
    )

    place = [*cell, "row_block", "query_block"]

    def blocked(side: DataFrame, own: str, other: str) -> DataFrame:
        spread = F.pmod(F.xxhash64("rep", "table"), F.col(f"{own}_blocks")).alias(f"{own}_block")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        spread_out = side.join(sizes, cell).select(*cell, "rep", "vec", spread, every)
        return spread_out.select(*place, F.lit(own == "query").alias("asks"), "rep", "vec")

    def nearest(block: pd.DataFrame) -> pd.DataFrame:
        queries, rows = block[block["asks"]], block[~block["asks"]]
        if queries.empty or rows.empty:
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        asked, given = np.stack(queries["vec"].to_numpy()), np.stack(rows["vec"].to_numpy())
        reps_here = rows["rep"].to_numpy()
        q, r, scores = best_rows(asked, given, reps_here, top + 1)
        return pd.DataFrame({"query": queries["rep"].to_numpy()[q], "rep": reps_here[r], "score": scores})

    both = blocked(probed, "query", "row").unionByName(blocked(indexed, "row", "query"))
    return both.groupBy(place).applyInPandas(nearest, "query long, rep long, score double")


def _listed(found: DataFrame, least: DataFrame, top: int) -> DataFrame:
    """``query, id, score, nth``: the best ``top + 1`` rows of each query."""
    # The best top + 1 vectors hold the best top + 1 rows.
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    vectors_found = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("nth", best).filter(F.col("nth") <= top + 1)
    expanded = vectors_found.select("query", "rep", "score").join(least, "rep")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return expanded.withColumn("nth", order).filter(F.col("nth") <= top + 1).select("query", "id", "score", "nth")


def search(
    vectors: DataFrame,
    is_query: Column,
    top: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found rows of every row for which ``is_query`` holds.

    All rows but the query itself are candidates. Ties go to the smaller id. Rows with a null id, or whose vector is null,
    empty, zero or has null or non-finite components, take no part; vectors of other dimensions are no candidates
    of a query. Repeated ids are rows of their own, and a query excludes all rows with its id. Other columns are not
    carried; an empty table gives an empty result.
    """
    vector = F.col(f"`{vector_col}`")
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), vector.cast("array<double>").alias("vec"), is_query.alias("asks")
    ).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    reps = settle(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.max(F.coalesce("asks", F.lit(False))).alias("asks")))
    members = settle(rows.join(reps.select("vec", "rep"), "vec").select("rep", "id", "asks"))
    # A query needs its own id left out, so one more than ``top`` of the smallest ids of equal vectors is enough.
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    least = members.select("rep", "id").distinct().withColumn("nth", nth).filter(F.col("nth") <= top + 1).drop("nth")
    asking = reps.filter("asks").select("rep", "vec")
    hashing = fitted(reps.select("rep", "vec"), asking, top, recall)

    indexed = reps.select("rep", "vec", F.inline(_keyed(hashing, _row_cells)("vec")))
    probed = asking.select("rep", "vec", F.inline(_keyed(hashing, _query_cells)("vec")))
    listed = settle(_listed(_compared(indexed, probed, top, QUERY_BLOCK), least, top))
    last = listed.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    state = asking.join(last.withColumnRenamed("query", "rep"), "rep", "left")
    # A full list holds the query itself, or one row more than it needs.
    known = F.when(F.col("n") > top, F.col("last"))
    again = settle(state.select("rep", "vec", _covering(hashing)("vec", known).alias("cover")).filter(F.col("cover") < recall).select("rep", "vec"))
    place = F.lit(TABLES).alias("table"), F.size("vec").cast("long").alias("cell")
    whole = _compared(reps.select("rep", "vec", *place), again.select("rep", "vec", *place), top, WHOLE_QUERY_BLOCK)
    kept = listed.join(again.select(F.col("rep").alias("query")), "query", "left_anti")
    listed = settle(kept.unionByName(_listed(whole, least, top)))
    asks = members.filter("asks").select(F.col("rep").alias("query"), F.col("id").alias("query_id")).distinct()
    answers = asks.join(listed, "query").filter("id != query_id")
    # Each list misses its own query at most once, so ranks after it move up by one.
    own = asks.join(listed, "query").filter("id = query_id").select("query_id", F.col("nth").alias("own"))
    return (
        answers.join(own, "query_id", "left")
        .withColumn("rank", (F.col("nth") - F.when(F.col("nth") > F.col("own"), 1).otherwise(0)).cast("int"))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
