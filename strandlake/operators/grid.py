"""Blocks of rows joined on a grid, and partial top-k lists that meet under a common floor.

Both sides of a search become rows of packed bytes. A query block and an index
block are one *cell*, and a task works through its cells as matrices. Query
blocks are written first: where they are small by that measure they are
broadcast to the index blocks, which stay where they are; else both sides are
dealt to a square grid of groups, about two cells of it for each core and no
more than two for each shuffle partition. A block is sent once for each group of
the other side, so what is shuffled grows with the input, not with its square
and not with the number of partitions that a larger input is given. Numbers that
single precision holds exactly are sent so. No row passes through the driver,
and the number of jobs does not depend on the number of queries.

A partial top-k list is a row too. In a first round each task sends the few best
scores of every query; their k-th is a floor that the k best of all reach. In
the second it sends only what reaches the floor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches, fresh_path

#: Bytes of a query block and of an index block, before they are packed; of all query blocks together, up to which they are broadcast.
QUERY_BYTES, INDEX_BYTES, BROADCAST = 4 << 20, 8 << 20, 32 << 20
#: Bytes of partial lists that a task holds before it sends them.
HELD = 128 << 20
_PACKED = "block long, n long, size long, rows binary"
_PARTIAL = "block long, part long, n long, heads binary, data binary"


def packed(rows: DataFrame, most: int) -> DataFrame:
    """block, n, size, rows: the rows of each task in Arrow streams of about ``most`` bytes, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            table = narrowed(pa.Table.from_batches(held).combine_chunks())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            data = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([table.num_rows]), pa.array([len(data)]), pa.array([data], pa.binary())], ["block", "n", "size", "rows"])

        for batch in batches:
            step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and size + part.nbytes > most:
                    yield out()
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += part.nbytes
        if held:
            yield out()

    return rows.mapInArrow(run, _PACKED)


def narrowed(table: pa.Table) -> pa.Table:
    """Columns of lists of doubles as floats, where that changes no number."""
    for i, field in enumerate(table.schema):
        if pa.types.is_list(field.type) and field.type.value_type == pa.float64():
            lists = table.column(i).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            if lists.null_count or lists.values.null_count:
                continue
            values = lists.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                less = values.astype(np.float32)
            if (less == values).all():
                offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
                table = table.set_column(i, field.name, pa.ListArray.from_arrays(offsets, pa.array(less)))
    return table


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of lists of one length."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def cells(queries: DataFrame, index: DataFrame, query_bytes: int = QUERY_BYTES, index_bytes: int = INDEX_BYTES, broadcast: int = BROADCAST) -> DataFrame:
    """q_block, q_rows, x_rows: every block of ``queries`` with every block of ``index``."""
    spark = queries.sparkSession
    # A row is a pair of blocks, later a block's lists: what a task is given at once must not grow with their number.
    bounded_batches(spark)
    path = fresh_path(spark, "queries")
    packed(queries, query_bytes).write.parquet(path)
    held = spark.read.schema(_PACKED).parquet(path)
    seen = held.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    small = seen["size"] <= broadcast
    sides = math.ceil(min(math.sqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1.5 * math.sqrt(spark.sparkContext.defaultParallelism)))
    groups = max(1, seen["blocks"] if small else sides)
    # A task's blocks in turn, beginning with another group in each task.
    group = lambda n: F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = held.select(group(groups).alias("q_group"), F.col("block").alias("q_block"), F.col("rows").alias("q_rows"))
    x = packed(index, index_bytes).select("block", F.col("rows").alias("x_rows"))
    if small:
        return x.select("x_rows", each(groups).alias("q_group")).join(F.broadcast(q), "q_group").select("q_block", "q_rows", "x_rows")
    x = x.select(group(sides).alias("x_group"), "x_rows", each(groups).alias("q_group"))
    q = q.select("*", each(sides).alias("x_group"))
    return x.join(q, ["q_group", "x_group"]).select("q_block", "q_rows", "x_rows")


def each_cell(batches: Iterator[pa.RecordBatch], query: Callable[[pa.Table], object]) -> Iterator[tuple[int, object, pa.Table]]:
    """(block, what ``query`` makes of its rows, index rows) of a task's cells; the last block of each side is kept, as the same object."""
    last: tuple[int | None, object] = (None, None)
    data, rows = None, None
    for batch in batches:
        for i, block in enumerate(batch.column("q_block").to_pylist()):
            if last[0] != block:
                last = (block, query(unpacked(batch.column("q_rows")[i].as_py())))
            if data != (data := batch.column("x_rows")[i].as_py()):
                rows = unpacked(data)
            yield block, last[1], rows


class Lists:
    """The k best (score, column) of every query of a block: highest scores, ties to smaller columns."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids = ids
        self.score = np.full((len(ids), k), -np.inf)
        self.where = np.full((len(ids), k), np.iinfo(np.int64).max)

    @property
    def nbytes(self) -> int:
        return self.score.nbytes + self.where.nbytes

    def add(self, where: np.ndarray, score: np.ndarray, of: slice = slice(None)) -> None:
        """Takes in scores of (queries, columns), -inf where there is none; ``where`` has the columns, of all or of each query; ``of`` are the queries."""
        held, held_at = self.score[of], self.where[of]
        k = held.shape[1]
        if score.shape[1] > 4 * k and np.isfinite(held[:, -1]).all():
            # All lists are full: only what comes before a list's last can enter, and only such lists change.
            q, c = np.divmod(np.flatnonzero(score >= held[:, -1:]), score.shape[1])
            self.enter(q, np.broadcast_to(where, score.shape)[q, c], score[q, c], of)
            return
        score = np.where(np.isnan(score), -np.inf, score)
        places = np.broadcast_to(where, score.shape)
        if score.shape[1] > 4 * k:
            # The k-th best of these bounds what can enter; its ties stay in by taking all that reach it.
            bound = np.maximum(np.partition(score, -k, axis=1)[:, -k], held[:, -1])
            q, c = np.divmod(np.flatnonzero((score >= bound[:, None]) & (score > -np.inf)), score.shape[1])
            self._merge(q, places[q, c], score[q, c], of)
            return
        held[:], held_at[:] = self._best(np.concatenate((held, score), 1), np.concatenate((held_at, places), 1))

    def enter(self, q: np.ndarray, where: np.ndarray, score: np.ndarray, of: slice = slice(None)) -> None:
        """Takes in single scores of full lists: ``q`` counts, in order, the queries of ``of``. Only what comes before a list's last changes it."""
        held, held_at = self.score[of], self.where[of]
        enter = (score > held[q, -1]) | (score == held[q, -1]) & (where < held_at[q, -1])
        self._merge(q[enter], where[enter], score[enter], of)

    def _merge(self, q: np.ndarray, where: np.ndarray, score: np.ndarray, of: slice) -> None:
        if not len(q):
            return
        held, held_at = self.score[of], self.where[of]
        rows, counts = np.unique(q, return_counts=True)
        at = np.arange(counts.max())[None, :] < counts[:, None]
        s, score, places = score, np.full(at.shape, -np.inf), np.full(at.shape, np.iinfo(np.int64).max)
        score[at], places[at] = s, where
        held[rows], held_at[rows] = self._best(np.concatenate((held[rows], score), 1), np.concatenate((held_at[rows], places), 1))

    def _best(self, score: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((places, -score), axis=1)[:, : self.score.shape[1]]
        return np.take_along_axis(score, order, 1), np.take_along_axis(places, order, 1)

    def above(self, floor: np.ndarray) -> bytes:
        """What reaches the queries' floors, as bytes: ids, how many each has, columns, scores."""
        keep = (self.score >= floor[:, None]) & np.isfinite(self.score)
        return b"".join((np.int64(len(self.ids)).tobytes(), self.ids.astype(np.int64).tobytes(), keep.sum(1).astype(np.int64).tobytes(), self.where[keep].tobytes(), self.score[keep].tobytes()))

    @staticmethod
    def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ids, counts = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
        m = int(counts.sum())
        return ids, counts, np.frombuffer(data, np.int64, m, 8 + 16 * n), np.frombuffer(data, np.float64, m, 8 + 16 * n + 8 * m)

    def take(self, data: bytes) -> None:
        ids, counts, where, score = Lists.read(data)
        wide = int(counts.max(initial=0))
        if not wide:
            return
        # The same block has its queries in the same order in every task.
        at = np.arange(wide)[None, :] < counts[:, None]
        s, w = np.full(at.shape, -np.inf), np.full(at.shape, np.iinfo(np.int64).max)
        s[at], w[at] = score, where
        self.add(w, s)


def partial_lists(batches, k: int, query, scores) -> Iterator[pa.RecordBatch]:
    """A task's partial lists: ``query`` gives (ids, anything) of a block's rows, ``scores`` puts a cell's into the block's lists."""
    held: dict[int, Lists] = {}
    part = TaskContext.get().partitionId() << 20

    def out():
        for block, lists in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([len(lists.ids)]), pa.array([lists.score.tobytes()], pa.binary()), pa.array([lists.above(np.full(len(lists.ids), -np.inf))], pa.binary())], ["block", "part", "n", "heads", "data"])

    for block, (ids, made), rows in each_cell(batches, query):
        if block not in held:
            if sum(x.nbytes for x in held.values()) > HELD:
                yield from out()
                held, part = {}, part + 1
            held[block] = Lists(ids, k)
        scores(held[block], made, rows)
    yield from out()


def merged(partials: DataFrame, k: int) -> DataFrame:
    """query_id, rank, col_id, score of partial lists (``_PARTIAL``): the k best of all, in two rounds.

    ``partials`` is written first. The heads of a block's P parts are its 2k / P
    best scores of every query, at least one; the floor is their k-th best.
    """
    spark = partials.sparkSession
    path = fresh_path(spark, "partials")
    partials.write.parquet(path)
    held = spark.read.schema(_PARTIAL).parquet(path)
    parts = held.groupBy("block").agg(F.count(F.lit(1)).alias("parts"))
    with_parts = held.join(parts, "block")

    def heads(batches):
        """Of each part only its first scores go on."""
        for batch in batches:
            rows = batch.to_pylist()
            cut = [np.frombuffer(r["heads"], np.float64).reshape(r["n"], -1)[:, : min(k, -(-2 * k // r["parts"]))] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("n"), pa.array([x.tobytes() for x in cut], pa.binary())], ["block", "n", "heads"])

    def floors(batches):
        """A stream of heads by block to one row of floors each."""
        now, best = None, None

        def out():
            floor = best[:, -1] if best.shape[1] == k else np.full(len(best), -np.inf)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([floor.tobytes()], pa.binary())], ["block", "floor"])

        for batch in batches:
            for r in batch.to_pylist():
                more = np.frombuffer(r["heads"], np.float64).reshape(r["n"], -1)
                if r["block"] != now:
                    if now is not None:
                        yield out()
                    now, best = r["block"], np.zeros((r["n"], 0))
                best = -np.sort(-np.concatenate((best, more), 1), axis=1)[:, :k]
        if now is not None:
            yield out()

    sent = with_parts.select("block", "parts", "n", "heads").mapInArrow(heads, "block long, n long, heads binary")
    floor = sent.repartition("block").sortWithinPartitions("block").mapInArrow(floors, "block long, floor binary")
    floor_path = fresh_path(spark, "floors")
    floor.write.parquet(floor_path)
    floor = spark.read.schema("block long, floor binary").parquet(floor_path)

    def survivors(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, counts, where, score = Lists.read(r["data"])
                keep = score >= np.repeat(np.frombuffer(r["floor"], np.float64), counts)
                left = np.bincount(np.repeat(np.arange(len(ids)), counts)[keep], minlength=len(ids)).astype(np.int64)
                out.append(b"".join((np.int64(len(ids)).tobytes(), ids.tobytes(), left.tobytes(), where[keep].tobytes(), score[keep].tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "data"])

    def final(batches):
        now, lists = None, None

        def out():
            n = np.isfinite(lists.score).sum(1)
            rank = np.concatenate([np.arange(1, x + 1) for x in n]) if len(n) else np.zeros(0, np.int64)
            found = np.isfinite(lists.score)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(lists.ids, n), pa.int64()), pa.array(rank.astype(np.int32)), pa.array(lists.where[found]), pa.array(lists.score[found])], ["query_id", "rank", "col_id", "score"])

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if block != now:
                    if now is not None:
                        yield out()
                    now, lists = block, Lists(Lists.read(data)[0], k)
                lists.take(data)
        if now is not None:
            yield out()

    left = held.join(floor, "block").select("block", "data", "floor").mapInArrow(survivors, "block long, data binary")
    return left.repartition("block").sortWithinPartitions("block").mapInArrow(final, "query_id long, rank int, col_id long, score double")
