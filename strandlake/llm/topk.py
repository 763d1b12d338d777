"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into equal segments, coarse to fine, and each segment keeps
its sum over the root of its length (a scaled mean) and its scaled deviation.
By Cauchy-Schwarz within each segment, an inner product is at most

    sum over segments of  mean_q * mean_x + deviation_q * deviation_x.

That is the squared-distance lower bound of such statistics, since
|q - x|^2 = |q|^2 + |x|^2 - 2 q.x with both norms known. Candidates whose bound
lies below a query's k-th best score so far are dropped at the coarsest level
that suffices; exact integer scores are computed for the survivors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import grid
from .common import Workspace, bounded_batches

#: Segments a level, coarse to fine; bytes of a block of queries and of a block of rows.
LEVELS, BLOCK, ROWS = (4, 16), 2 << 20, 4 << 20
#: The score of a place that no row has.
NONE = np.iinfo(np.int64).min


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): scaled means and deviations, whose inner product bounds that of the rows."""
    n, d = x.shape
    width = -(-d // segments)
    padded = np.zeros((n, segments * width))
    padded[:, :d] = x
    parts = padded.reshape(n, segments, width)
    total = parts.sum(2)
    square = np.maximum((parts**2).sum(2) - total**2 / width, 0)
    return np.concatenate((total / np.sqrt(width), np.sqrt(square)), axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: in floating point only where that is exact too."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    out = q.astype(object) @ x.astype(object).T
    if out.size and max(abs(out.min()), abs(out.max())) >= 2**63:
        raise OverflowError("a score does not fit into 64 bits")
    return out.astype(np.int64)


class Search:
    """The queries of one block and, for each, its best rows so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        x = vectors.astype(np.float64)
        self.levels, self.norm = [statistics(x, s) for s in LEVELS], np.sqrt((x**2).sum(1))
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pairs = self.exact = 0

    def floors(self) -> np.ndarray:
        """The score of each query's k-th best row, minus infinity before there are k."""
        last = self.score[:, -1]
        return np.where(last == NONE, -np.inf, last.astype(np.float64))

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(rows):
            return
        x = vectors.astype(np.float64)
        # A little less than the floor: bounds and scores are compared in floating point.
        floor = self.floors() - 1e-6 - 1e-9 * self.norm * np.sqrt((x**2).sum(1).max())
        live = self.rows[:, None] != rows[None, :]
        self.pairs += live.size
        for level, s in zip(self.levels, LEVELS):
            some = live.any(1)
            if not some.any():
                return
            live[some] &= level[some] @ statistics(x, s).T >= floor[some, None]
        use = np.flatnonzero(live.any(1))
        for first in range(0, len(use), 256):
            some = use[first : first + 256]
            column = np.flatnonzero(live[some].any(0))
            open_ = live[np.ix_(some, column)]
            score = np.where(open_, products(self.vectors[some], vectors[column]), NONE)
            self.exact += int(open_.sum())
            all_score = np.concatenate((self.score[some], score), axis=1)
            all_found = np.concatenate((self.found[some], np.where(open_, ids[column], np.iinfo(np.int64).max)), axis=1)
            # Scores above the least number can be turned around without overflow.
            order = np.lexsort((all_found, -np.maximum(all_score, NONE + 1), all_score == NONE), axis=1)[:, : self.k]
            self.score[some] = np.take_along_axis(all_score, order, 1)
            self.found[some] = np.take_along_axis(all_found, order, 1)

    def table(self) -> pa.RecordBatch:
        held = self.score != NONE
        n = held.sum(1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.rows, n)), pa.array(np.repeat(self.ids, n)), pa.array(self.found[held]), pa.array(self.score[held])], ["query_row", "query_id", "vec_id", "score"])


def by_size(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of a block by the vectors' number of components."""
    column = rows.column("v").combine_chunks()
    ends = column.offsets.to_numpy()
    sizes, flat = np.diff(ends), column.values.to_numpy()
    row, ids, out = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = row[at], ids[at], flat[(ends[:-1][at][:, None] + np.arange(d)).ravel()].reshape(-1, d)
    return out


def usable(table: DataFrame, scale: int) -> DataFrame:
    """row, vec_id, v (array<long>, floor(scale * x)) of rows whose vectors are whole and finite; ``row`` numbers them."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    whole = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", lambda x: whole(F.lit(scale) * x.cast("double"))).alias("v"))


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query row.

    Queries are rows whose vec_id is divisible by ``every``; candidates are all
    rows but the query's own, with as many components. Ties go to smaller ids.
    Null vectors, vectors that hold null or a non-finite component, empty ones
    and null ids take no part. Rows that repeat a vec_id are rows like others:
    each is a candidate, also of the rows it repeats, and each is a query if its
    id says so. Scores are exact; a component or score of more than 64 bits is
    an error. Extra columns are ignored; an empty table gives an empty result.

    Queries and rows meet as blocks on the grid of ``operators.grid``: nothing
    passes through the driver, and the number of jobs is the same for any number
    of queries. A task keeps the floors of its queries over all of its rows.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "topk")
    rows = space.save(usable(table, scale), "rows")

    def run(batches):
        held: dict[tuple[int, int], Search] = {}
        for number, q, x in grid.each_cell(batches, by_size):
            if all(n != number for n, _ in held) and sum(s.score.nbytes + s.found.nbytes for s in held.values()) > grid.HELD:
                for s in held.values():
                    yield s.table()
                held = {}
            for d, (row, ids, vectors) in by_size(x).items():
                if d in q:
                    if (number, d) not in held:
                        held[number, d] = Search(*q[d], k)
                    for at in range(0, len(row), 2048):
                        held[number, d].add(row[at : at + 2048], ids[at : at + 2048], vectors[at : at + 2048])
        for s in held.values():
            yield s.table()

    met = grid.cells(rows.filter(F.col("vec_id") % every == 0), rows, block, ROWS)
    found = met.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
