"""Exact top-k by inner product with vector-approximation blocks.

Vectors are dealt at random into blocks. A block keeps, beside its exact
vectors, an approximation of one byte per component: the number of the cell,
of even width, that the component lies in. A block of queries scans the
approximations first. They bound every inner product from both sides. Exact
vectors are then read in the order of their upper bounds, until the k-th best
exact score is above every bound left. Vectors so large that bounds would not
be exact as doubles are scored one by one in integers of any size. The k best
of each pair of blocks are merged by a window.

Defined results: a component x counts as floor(scale * x), x as double.
Vectors that are null, or hold null or non-finite components, take no part.
A component may be of any size; only a score beyond 64 bits that is among a
query's k best is an error. Vectors of another length than the query's are no
candidates. Rows that repeat an id are candidates each; as
queries they count once, with the row that sorts first. Ties go to the smaller
id. A query has fewer than k results if there are fewer candidates. Empty
tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATA_BLOCK = 16_384
QUERY_BLOCK = 2_048
CELLS = 256
#: Exact vectors are read in runs of so many.
RUN = 64
#: Bounds are held for so many pairs at once.
_PAIRS = 1 << 22

#: ``beyond`` is 1 or -1 for scores above or below 64 bits, which are ordered by their bytes in ``wide``.
_HITS = "query_id long, vec_id long, beyond int, wide binary, score long"
#: Bytes for the size of any inner product of doubles.
_WIDE = 300


def usable(embedding: Column) -> Column:
    """Components as doubles, or null if the vector takes no part."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf))

    return F.when(F.forall(embedding, finite), F.transform(embedding, lambda x: x.cast("double")))


def exact_floor(x: float, scale: int) -> int:
    """floor(scale * x); doubles of 2**53 and more are integers."""
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


class Approximation:
    """Cell numbers of a block's vectors, and inner-product bounds from them."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
        self.low, self.width = low, max(1, math.ceil((high - low + 1) / cells))
        self.cells = ((vectors - low) // self.width).astype(np.uint8)

    def upper_and_gap(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds (queries by vectors), and how far each query's lower bounds lie below them.

        A component in cell c lies between its corner low + width * c and
        width - 1 above. Exact as doubles for components up to ``safe_size``.
        """
        q = queries.astype(np.float64)
        corner = (q @ self.cells.T.astype(np.float64)) * self.width + self.low * q.sum(axis=1, keepdims=True)
        most = (self.width - 1) * np.maximum(q, 0).sum(axis=1, keepdims=True)
        return corner + most, (self.width - 1) * np.abs(q).sum(axis=1)


def safe_size(dims: int) -> int:
    """Largest size of components with which bounds of so many dimensions stay below 2**53."""
    return math.isqrt(2**50 // max(1, dims)) - CELLS


def exact_top_k(
    query_ids: np.ndarray, queries: list[list[int]], ids: np.ndarray, vectors: list[list[int]], k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """The same as ``block_top_k``, in integers of any size."""
    names = ids.tolist()
    for name, query in zip(query_ids, queries, strict=True):
        scores = [sum(map(mul, vector, query)) for vector in vectors]
        best = heapq.nsmallest(k, ((-score, i) for score, i in zip(scores, names, strict=True) if i != name))
        yield np.full(len(best), name), np.array([i for _, i in best], np.int64), [-score for score, _ in best]


def block_top_k(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores): for each query its k best rows of the block other than its own."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    approximation = Approximation(vectors)
    step = max(1, _PAIRS // len(ids))
    for begin in range(0, len(queries), step):
        part, names = queries[begin : begin + step], query_ids[begin : begin + step]
        bounds, gaps = approximation.upper_and_gap(part)
        for query, name, upper, gap in zip(part, names, bounds, gaps, strict=True):
            upper[np.searchsorted(ids, name, "left") : np.searchsorted(ids, name, "right")] = -np.inf
            least = -np.inf
            if len(upper) > k:  # no row below the k-th lower bound can be among the k best
                least = np.partition(upper, len(upper) - k)[len(upper) - k] - gap
            able = np.flatnonzero((upper >= least) & (upper > -np.inf))
            able = able[np.argsort(-upper[able], kind="stable")]
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for run in range(0, len(able), RUN):
                if len(best) == k and upper[able[run]] < best[-1]:
                    break
                read = able[run : run + RUN]
                best_ids, best = np.append(best_ids, ids[read]), np.append(best, vectors[read] @ query)
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
            yield np.full(len(best), name), best_ids, best


def pairs_top_k(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | list[int]]]:
    """For each query its best rows of the block: k of those that bounds serve and k of the others."""
    most = safe_size(vectors.shape[1])
    with np.errstate(over="ignore"):
        floors = [np.floor(scale * rows) for rows in (queries, vectors)]
    asked, held = ((np.abs(rows) <= most).all(axis=1) for rows in floors)

    def wide(rows: np.ndarray) -> list[list[int]]:
        return [[exact_floor(x, scale) for x in row] for row in rows.tolist()]

    if asked.any() and held.any():
        small = [rows[safe].astype(np.int64) for rows, safe in zip(floors, (asked, held), strict=True)]
        yield from block_top_k(query_ids[asked], small[0], ids[held], small[1], k)
    for q, v in ((asked, ~held), (~asked, np.ones_like(held))):
        if q.any() and v.any():
            yield from exact_top_k(query_ids[q], wide(queries[q]), ids[v], wide(vectors[v]), k)


def _beyond(score: int) -> int:
    return (score >= 2**63) - (score < -(2**63))


def _searcher(k: int, scale: int) -> Callable:
    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return ids, flat.astype(np.float64).reshape(len(ids), -1)

    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        found = list(pairs_top_k(*vectors(queries), *vectors(data), k, scale)) if queries.num_rows and data.num_rows else []
        query_id, vec_id = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2))
        scores = [score for f in found for score in (f[2] if isinstance(f[2], list) else f[2].tolist())]
        beyond = [_beyond(x) for x in scores]
        wide = [(x + 2 ** (8 * _WIDE - 1)).to_bytes(_WIDE, "big") if y else None for x, y in zip(scores, beyond, strict=True)]
        score = [None if y else x for x, y in zip(scores, beyond, strict=True)]
        return pa.table(
            [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(beyond, pa.int32()),
             pa.array(wide, pa.binary()), pa.array(score, pa.int64())],
            names=["query_id", "vec_id", "beyond", "wide", "score"],
        )

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    data_block: int = DATA_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` for each row of ``queries`` (vec_id, embedding)."""

    def clean(rows: DataFrame) -> DataFrame:
        made = rows.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("vector"))
        return made.where("vec_id IS NOT NULL AND vector IS NOT NULL").withColumn("dims", F.size("vector"))

    data, asked = clean(vectors), clean(queries)
    asked = asked.groupBy("vec_id").agg(F.min_by(F.struct("vector", "dims"), "vector").alias("v")).select("vec_id", "v.*")
    data_blocks = max(1, math.ceil(vectors.count() / data_block))
    query_blocks = max(1, math.ceil(queries.count() / query_block))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # a block by a hash, so that a task that runs again draws the same; rows that repeat spread by their task
    drawn = F.xxhash64("vec_id", "vector", F.spark_partition_id())
    data = data.withColumn("d", F.pmod(drawn, F.lit(data_blocks)).cast("int")).withColumn("q", every(query_blocks))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("d", every(data_blocks))
    keys = ["dims", "q", "d"]
    hits = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(_searcher(k, scale), _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("wide"), F.desc("score"), "vec_id")
    found = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    wrong = F.raise_error(F.lit("a score among the best is beyond 64 bits")).cast("long")
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(wrong)
    return found.select("query_id", "rank", "vec_id", score.alias("score"))
