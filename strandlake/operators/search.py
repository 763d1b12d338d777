"""Similarity joins of query vectors with an index: top-k, cut-offs, histograms, refinement.

Queries and index meet as packed blocks on a grid (``grid``): a cell is one
product of two matrices in a task, and no pair becomes a row unless it is a
result. Top-k lists meet under a common floor.

A product is taken in single precision first. What its error leaves open, and
every score that is given out, is computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.quant import e4m3_numpy
from . import grid

#: Bytes of one block of queries and of the index, so small that even a few hundred MB are dealt evenly; index rows and queries of one product's tile, whose scores stay in a core's cache.
BLOCK_BYTES, ROW_BYTES, TILE, TILE_QUERIES = 1 << 20, 2 << 20, 1024, 256
#: Bytes of a block of windows that are encoded where they are compared, whose vectors are some twenty times as large; of the queries that meet them; of the vectors of a block of pieces.
WINDOW_BYTES, WINDOW_QUERIES, VECTOR_BYTES = 1 << 20, grid.QUERY_BYTES, 32 << 20
#: A tile of which more than one pair in so many is left open is computed in double precision as a whole.
OPEN = 100
SCHEMA = "query_id long, col_id long, score double"


def quantize(x: np.ndarray, precision: str) -> np.ndarray:
    """The matrix on the grid of a precision, held as float64: products of such numbers are exact enough to compare."""
    x = np.asarray(x, np.float64)
    if precision == "e4m3":
        return e4m3_numpy(x)
    if precision == "f16":
        return x.astype(np.float16).astype(np.float64)
    return x.astype(np.float32).astype(np.float64) if precision == "f32" else x


def _scores(queries: np.ndarray, rows: np.ndarray, kind: str) -> Iterator[tuple[slice, np.ndarray]]:
    """(which queries, their scores) of a tile of index rows, rounded to 12 decimals; no array is larger than a tile.

    'real' ('euc') is the real inner product, 'complex' ('abs2') the squared modulus of the complex one, 'abs' its modulus.
    """
    if kind not in ("real", "euc"):
        half = rows.shape[1] // 2
        turned = np.concatenate((rows[:, half:], -rows[:, :half]), axis=1)
    for at in range(0, len(queries), TILE_QUERIES):
        of = slice(at, at + TILE_QUERIES)
        score = queries[of] @ rows.T
        if kind not in ("real", "euc"):
            other = queries[of] @ turned.T
            np.multiply(score, score, out=score)
            np.multiply(other, other, out=other)
            score += other
            if kind == "abs":
                np.sqrt(score, out=score)
        yield of, np.round(score, 12, out=score)


class Vectors:
    """A matrix, and its image in single precision unless its numbers are too large for that, or none."""

    def __init__(self, exact: np.ndarray):
        self.exact, self.rough = exact, None
        with np.errstate(over="ignore", invalid="ignore"):
            self.length = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        if (self.length < 1e9).all():
            self.rough = exact.astype(np.float32)

    def part(self, of: slice) -> Vectors:
        out = Vectors.__new__(Vectors)
        out.exact, out.length, out.rough = self.exact[of], self.length[of], None if self.rough is None else self.rough[of]
        return out


class Windows:
    """As ``Vectors``, of windows at ``starts`` of a text's bins. Their image in single precision comes first, and only what it leaves open is computed exactly."""

    def __init__(self, encoder, slots: np.ndarray, starts: np.ndarray, precision: str):
        self.encoder, self.slots, self.starts, self.precision = encoder, slots, starts, precision
        self.rough, self.whole = None, None
        if encoder.rope.normalize == 0 and precision in ("f32", "f64"):
            self.rough = encoder.rough(slots[starts])
            # Lengths are 1. The image is a few roundings further from the exact numbers than that of ``Vectors``, so 16 more are reckoned with than the sum has.
            self.length = np.full(len(starts), 1 + 8 / encoder.rope.dim)

    @property
    def exact(self) -> np.ndarray:
        if self.whole is None:
            self.whole = self.rows(np.arange(len(self.starts)))
        return self.whole

    def rows(self, which: np.ndarray) -> np.ndarray:
        if self.whole is not None:
            return self.whole[which]
        return quantize(self.encoder.vectors(self.slots[self.starts[which]]), self.precision)


def _pairs(q: Vectors, x: Vectors | Windows, i: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """As ``_scores_of``; of windows only those are computed that have a pair."""
    if not isinstance(x, Windows):
        return _scores_of(q.exact, x.exact, i, c, kind)
    which, place = np.unique(c, return_inverse=True)
    return _scores_of(q.exact, x.rows(which), i, place, kind)


def _rough(q: Vectors, x: Vectors, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(queries, columns) products in single precision, and for each query how far they may be off; squared moduli for 'complex' and 'abs'."""
    unit, most = 2.0**-24, q.length * x.length.max(initial=0)
    # Both roundings to single precision, and a sum of that many products in any order.
    off = 1.02 * (q.exact.shape[1] + 4) * unit * most + 1e-30
    score = q.rough @ x.rough.T
    if kind in ("real", "euc"):
        return score, off + 1e-12
    half = x.rough.shape[1] // 2
    other = q.rough @ np.concatenate((x.rough[:, half:], -x.rough[:, :half]), axis=1).T
    np.multiply(score, score, out=score)
    np.multiply(other, other, out=other)
    score += other
    return score, 3 * most * off + 2 * off**2 + 8 * unit * (most + off) ** 2 + 1e-12


def _reaching(rough: np.ndarray, off: np.ndarray, least: np.ndarray, kind: str) -> np.ndarray:
    """Where a score may be ``least`` (of each query, or of each query and column), as places in the flat tile."""
    if kind == "abs":
        least = np.where(least > 1e-12, (least - 1e-12) ** 2, -np.inf)
    off = off[:, None] if len(least) > 1 else off.max(initial=0)
    return np.flatnonzero(rough >= np.nextafter((least - off).astype(np.float32), np.float32(-np.inf)))


def _scores_of(q: np.ndarray, x: np.ndarray, i: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """As ``_scores``, of single pairs."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1024):
        a, b = q[i[at : at + 1024]], x[c[at : at + 1024]]
        score = np.einsum("ij,ij->i", a, b)
        if kind not in ("real", "euc"):
            half = a.shape[1] // 2
            other = np.einsum("ij,ij->i", a[:, :half], b[:, half:]) - np.einsum("ij,ij->i", a[:, half:], b[:, :half])
            score = score**2 + other**2
            score = np.sqrt(score) if kind == "abs" else score
        out[at : at + 1024] = np.round(score, 12)
    return out


def _tiled(q: Vectors) -> Iterator[tuple[slice, Vectors]]:
    for at in range(0, len(q.exact), TILE_QUERIES):
        yield slice(at, at + TILE_QUERIES), q.part(slice(at, at + TILE_QUERIES))


def _into_lists(lists: grid.Lists, queries: Vectors, col: np.ndarray, x: Vectors | Windows, kind: str) -> None:
    """Every list takes in its query's scores with ``x``."""
    for of, q in _tiled(queries):
        floor = lists.score[of, -1:]
        if q.rough is not None and x.rough is not None and np.isfinite(floor).all():
            # A query of zeros (a read of Gs alone) ties with every column: all its scores are 0, so only the smallest columns count.
            none = np.flatnonzero(q.length == 0)
            at = _reaching(*_rough(q, x, kind), np.where(q.length[:, None] == 0, np.inf, floor), kind)
            if OPEN * len(at) <= len(q.exact) * len(col):
                i, c = np.divmod(at, len(col))
                lists.enter(i, col[c], _pairs(q, x, i, c, kind), of)
                if len(none):
                    first = np.sort(col)[: lists.score.shape[1]]
                    lists.enter(np.repeat(none, len(first)), np.tile(first, len(none)), np.zeros(len(none) * len(first)), of)
                continue
        for _, score in _scores(q.exact, x.exact, kind):
            lists.add(col, score, of)


def _above(queries: Vectors, x: Vectors, cut: np.ndarray, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, columns, scores) of the pairs whose score is above the column's cut."""
    for of, q in _tiled(queries):
        if q.rough is not None and x.rough is not None:
            at = _reaching(*_rough(q, x, kind), cut[None, :], kind)
            if OPEN * len(at) <= len(q.exact) * len(cut):
                i, c = np.divmod(at, len(cut))
                score = _scores_of(q.exact, x.exact, i, c, kind)
                keep = score > cut[c]
                yield of.start + i[keep], c[keep], score[keep]
                continue
        for _, score in _scores(q.exact, x.exact, kind):
            i, c = np.divmod(np.flatnonzero(score > cut[None, :]), len(cut))
            yield of.start + i, c, score[i, c]


def _least(queries: Vectors, x: Vectors, least: np.ndarray, kind: str) -> np.ndarray:
    """The smallest of ``least`` and of each column's scores; NaN counts as none."""
    for of, q in _tiled(queries):
        if q.rough is not None and x.rough is not None and kind != "abs":
            score, off = _rough(q, x, kind)
            off = off.max()
            # What lies below the tile's least and below the least before, give or take the errors.
            below = np.fmin(score.min(0) + off, least) + off
            at = np.flatnonzero(score <= np.nextafter(below.astype(np.float32), np.float32(np.inf))[None, :])
            if OPEN * len(at) <= score.size:
                i, c = np.divmod(at, len(least))
                least = least.copy()
                np.fmin.at(least, c, _scores_of(q.exact, x.exact, i, c, kind))
                continue
        for _, score in _scores(q.exact, x.exact, kind):
            least = np.fmin(least, np.fmin.reduce(score, axis=0))
    return least


def _vectors(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.filter("vec is not null").select(*columns, "vec")


def _query(precision: str):
    def parse(rows: pa.Table):
        ids = rows.column("query_id").to_numpy().astype(np.int64)
        return ids, Vectors(quantize(grid.matrix(rows.column("vec")), precision))

    return parse


def _kept(make):
    """``make`` of an index block; what it made of the last one is kept."""
    last, held = None, []

    def tiles(rows: pa.Table) -> list[tuple[np.ndarray, Vectors]]:
        nonlocal last, held
        if rows is not last:
            last, held = rows, make(rows)
        return held

    return tiles


def _tiles(precision: str):
    """(columns, vectors) of an index block (col_id, vec), some rows at a time."""

    def make(rows: pa.Table) -> list[tuple[np.ndarray, Vectors]]:
        col, values = rows.column("col_id").to_numpy(), quantize(grid.matrix(rows.column("vec")), precision)
        return [(col[at : at + TILE], Vectors(values[at : at + TILE])) for at in range(0, len(col), TILE)]

    return _kept(make)


def _coded_tiles(rope, precision: str):
    """As ``_tiles``, of blocks of windows (col_id, frag)."""
    from .encode import Encoder

    encoder = Encoder(rope)

    def make(rows: pa.Table) -> list[tuple[np.ndarray, Vectors]]:
        col, texts = rows.column("col_id").to_numpy(), rows.column("frag").to_pylist()
        return [(col[at : at + TILE], Vectors(quantize(encoder(texts[at : at + TILE])[0], precision))) for at in range(0, len(col), TILE)]

    return _kept(make)


def _piece_tiles(rope, kstep: int, precision: str):
    """As ``_tiles``, of blocks of pieces (col_id, text): the windows of both strands."""
    from .encode import _CODE, Encoder

    encoder, code = Encoder(rope), _CODE.astype(np.uint8)

    def make(rows: pa.Table) -> list[tuple[np.ndarray, Vectors]]:
        base, texts = rows.column("col_id").to_numpy(), rows.column("text").to_pylist()
        lengths = np.array([len(t) for t in texts], np.int64)
        n = (lengths - rope.k) // kstep + 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(np.cumsum(lengths) - lengths, n) + within * kstep
        col = np.repeat(base, n) + 2 * kstep * within
        held = []
        for strand, slots in enumerate(encoder.places(code[np.frombuffer(b"".join(texts), np.uint8)])):
            held += [(col[at : at + TILE] + strand, Windows(encoder, slots, starts[at : at + TILE], precision)) for at in range(0, len(starts), TILE)]
        return held

    return _kept(make)


def top_k(queries: DataFrame, index: DataFrame, k: int = 20, kind: str = "real", precision: str = "f64", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, col_id, score: the k best windows of every query, ties to smaller col_id.

    ``queries`` has (query_id, vec), ``index`` (col_id, vec); vectors of equal
    size. ``kind`` is 'real' or 'complex' (squared modulus). Null vectors take
    no part. Scores are rounded to 12 decimals so that ties are ties.
    """

    def run(batches):
        tiles = _tiles(precision)

        def scores(lists, matrix, rows):
            for col, values in tiles(rows):
                _into_lists(lists, matrix, col, values, kind)

        yield from grid.partial_lists(batches, k, _query(precision), scores)

    found = grid.cells(_vectors(queries, "query_id"), _vectors(index, "col_id"), block_bytes, ROW_BYTES)
    return grid.merged(found.mapInArrow(run, grid._PARTIAL), k)


def top_k_of_windows(queries: DataFrame, frags: DataFrame, rope, k: int = 20, kind: str = "real", precision: str = "f32", block_bytes: int = WINDOW_QUERIES) -> DataFrame:
    """As ``top_k`` over windows (col_id, frag) that are encoded where they are multiplied: no vector leaves its task.

    All blocks of queries meet a block of windows in turn, which is encoded once for them.
    """

    def run(batches):
        tiles = _coded_tiles(rope, precision)

        def scores(lists, matrix, rows):
            for col, values in tiles(rows):
                _into_lists(lists, matrix, col, values, kind)

        yield from grid.partial_lists(batches, k, _query("f64"), scores)

    found = grid.cells(_vectors(queries, "query_id"), frags.select("col_id", "frag"), block_bytes, WINDOW_BYTES)
    return grid.merged(found.mapInArrow(run, grid._PARTIAL), k)


def top_k_of_pieces(queries: DataFrame, pieces: DataFrame, rope, kstep: int, k: int = 20, kind: str = "real", precision: str = "f32", block_bytes: int = WINDOW_QUERIES) -> DataFrame:
    """As ``top_k_of_windows``, of the windows of both strands of pieces (col_id, text) of records.

    A window's number is that of its piece's first window and twice its distance
    from there, and 1 more on the other strand. A piece is sent as it is: its
    windows are cut, turned and encoded where they are multiplied.
    """
    # Vectors are held in double and single precision.
    most = max(1, VECTOR_BYTES // (24 * rope.dim) // 2) * kstep

    def run(batches):
        tiles = _piece_tiles(rope, kstep, precision)

        def scores(lists, matrix, rows):
            for col, values in tiles(rows):
                _into_lists(lists, matrix, col, values, kind)

        yield from grid.partial_lists(batches, k, _query("f64"), scores)

    found = grid.cells(_vectors(queries, "query_id"), pieces.select("col_id", "text"), block_bytes, most)
    return grid.merged(found.mapInArrow(run, grid._PARTIAL), k)


def least_by_column(queries: DataFrame, index: DataFrame, kind: str = "real", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """col_id, cut: each window's least score over all queries; one row for each window and stretch of blocks that meet it in turn."""

    def run(batches):
        tiles, last, held = _tiles("f64"), None, []

        def out():
            for (col, _), least in zip(tiles(last), held):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(least), np.int64)), pa.array(col, pa.int64()), pa.array(least)], ["query_id", "col_id", "score"])

        for _, (_, matrix), rows in grid.each_cell(batches, _query("f64")):
            if rows is not last:
                if last is not None:
                    yield from out()
                last, held = rows, [np.full(len(col), np.nan) for col, _ in tiles(rows)]
            held = [_least(matrix, values, least, kind) for (_, values), least in zip(tiles(rows), held)]
        if last is not None:
            yield from out()

    found = grid.cells(_vectors(queries, "query_id"), _vectors(index, "col_id"), block_bytes, ROW_BYTES)
    return minimum_by_column(found.mapInArrow(run, SCHEMA))


def calibrated_cuts(frags: DataFrame, rope, rounds: int = 8, err: float = 0.15, seed: int = 0, shift: float = 0.0) -> DataFrame:
    """col_id, cut: the least squared modulus of the product of each window (col_id, frag) with itself mutated, over ``rounds``.

    ``shift`` moves the window before it is mutated. A window's draws follow from
    the seed, its number and the round; windows are encoded and compared in one
    Arrow step and nothing is shuffled. Vectors of one norm are brought to length
    1 without its guard, so that a window whose bins all but cancel out also has
    a product of 1 with itself.
    """
    from .encode import _CODE, Encoder
    from .sampling import mutate, mutate_shift

    def unit(x):
        length = np.sqrt((x**2).sum(1, keepdims=True))
        return np.divide(x, length, out=x, where=length > 0) if rope.normalize == 0 else x

    def run(batches):
        encoder, letters = Encoder(rope), np.frombuffer(b"ACGT", np.uint8)
        for batch in batches:
            ids, texts = batch.column("col_id").to_pylist(), batch.column("frag").to_pylist()
            for at in range(0, len(texts), 64):
                some = texts[at : at + 64]
                held = unit(encoder(some)[0])
                cut = np.full(len(some), np.inf)
                for n in range(rounds):
                    other = []
                    for i, text in zip(ids[at : at + 64], some):
                        rng = np.random.default_rng([seed & 0xFFFFFFFF, int(i) & 0xFFFFFFFFFFFFFFFF, n])
                        code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)].astype(np.uint8)
                        code = mutate_shift(code, shift, rng) if shift else code
                        other.append(letters[mutate(code, err, rng) if err else code].tobytes().decode())
                    changed = unit(encoder(other)[0])
                    half = held.shape[1] // 2
                    turned = np.concatenate((changed[:, half:], -changed[:, :half]), axis=1)
                    cut = np.minimum(cut, (held * changed).sum(1) ** 2 + (held * turned).sum(1) ** 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 64], pa.int64()), pa.array(cut)], ["col_id", "cut"])

    return frags.select("col_id", "frag").mapInArrow(run, "col_id long, cut double")


def two_phase(reads: DataFrame, records: DataFrame, frags: DataFrame, rope, cuts: DataFrame | float, merge: int, margin: int) -> DataFrame:
    """read_id, rec_id, strand, start, score: the best offset of every read that reaches some window's cut, on either strand.

    ``frags`` has the index's windows (col_id, rec_id, start, strand, frag).
    First all windows above their cuts, by squared modulus; neighbouring ones of
    one record and strand less than ``merge`` apart become one range. Then the
    product at every offset of each range, ``margin`` beyond both its ends.
    """
    from .encode import encode
    from .scoring import merge_ranges

    frag = F.substring("frag", 1, rope.k)
    coded = encode(reads.select(F.col("read_id").alias("query_id"), frag.alias("frag")).filter(F.length("frag") == rope.k), rope, "f64")
    hits = above_cuts_of_windows(coded, frags, cuts, rope, "complex").join(frags.select("col_id", "rec_id", "start", "strand"), "col_id")
    # One range search for each read, record and strand: the order of starts is the order of hits.
    of = F.struct(F.col("query_id").alias("read_id"), "rec_id", "strand")
    ordered = hits.select(of.alias("read_id"), F.col("start").alias("j"), F.lit(1).alias("piece"), F.col("start").alias("loc"))
    found = merge_ranges(ordered, merge).select("read_id.read_id", "read_id.rec_id", "read_id.strand", "first", "last")
    best = refine_ranges(found, reads.withColumn("frag", frag), records, rope, margin)
    w = W.partitionBy("read_id").orderBy(F.desc("score"), "rec_id", "strand", "start")
    return best.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def above_cuts(queries: DataFrame, index: DataFrame, cuts: DataFrame | Column | float, kind: str = "real", precision: str = "f64", most: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All pairs whose score is above the window's own cut (strictly).

    ``cuts`` is one number, an expression of the index's columns, or a table
    (col_id, cut) that is joined to the index. ``most`` is the number of hits of
    one block of queries in one partition above which the search fails; nothing
    is ever left out silently.

    The result may be many times the input. A query's pairs with a whole block
    stand together, by column, and a task works through one block of the index
    after the other: files of the result then hold a query once for all of them,
    and few different columns at a time.
    """
    cut = F.lit(float(cuts)) if isinstance(cuts, (int, float)) else cuts.cast("double") if isinstance(cuts, Column) else None
    rows = index.filter("vec is not null").select("col_id", "vec", cut.alias("cut")) if cut is not None else index.filter("vec is not null").select("col_id", "vec").join(cuts.select("col_id", F.col("cut").cast("double").alias("cut")), "col_id")

    def run(batches):
        tiles, total = _tiles(precision), {}
        for block, (ids, matrix), rows in grid.each_cell(batches, _query(precision)):
            cut_of, col = rows.column("cut").to_numpy(), rows.column("col_id").to_numpy()
            for of, some in _tiled(matrix):
                found, at = [], 0
                for part, values in tiles(rows):
                    found += [(q, at + c, score) for q, c, score in _above(some, values, cut_of[at : at + len(part)], kind)]
                    at += len(part)
                q, c, score = (np.concatenate(x) for x in zip(*found))
                total[block] = total.get(block, 0) + len(q)
                if most is not None and total[block] > most:
                    raise OverflowError(f"more than {most} hits")
                if len(q):
                    order = np.argsort(q * len(col) + c)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of][q[order]]), pa.array(col[c[order]], pa.int64()), pa.array(score[order])], ["query_id", "col_id", "score"])

    return grid.cells(_vectors(queries, "query_id"), rows, block_bytes, ROW_BYTES).mapInArrow(run, SCHEMA)


def above_cuts_of_windows(queries: DataFrame, frags: DataFrame, cuts: DataFrame | float, rope, kind: str = "real", block_bytes: int = WINDOW_QUERIES) -> DataFrame:
    """As ``above_cuts`` over windows (col_id, frag) that are encoded where they are multiplied: no vector leaves its task."""
    rows = frags.select("col_id", "frag")
    rows = rows.withColumn("cut", F.lit(float(cuts))) if isinstance(cuts, (int, float)) else rows.join(cuts.select("col_id", F.col("cut").cast("double").alias("cut")), "col_id")

    def run(batches):
        tiles = _coded_tiles(rope, "f64")
        for _, (ids, matrix), rows in grid.each_cell(batches, _query("f64")):
            cut_of, at = rows.column("cut").to_numpy(), 0
            for col, values in tiles(rows):
                for q, c, score in _above(matrix, values, cut_of[at : at + len(col)], kind):
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(col[c], pa.int64()), pa.array(score)], ["query_id", "col_id", "score"])
                at += len(col)

    return grid.cells(_vectors(queries, "query_id"), rows, block_bytes, WINDOW_BYTES).mapInArrow(run, SCHEMA)


def similarity_histogram(queries: DataFrame, index: DataFrame, kind: str = "real", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """bin, n over all pairs: 34 bins, counted inside each partition."""

    def run(batches):
        tiles, counts = _tiles("f64"), np.zeros(35, np.int64)
        for _, (_, matrix), rows in grid.each_cell(batches, _query("f64")):
            for _, values in tiles(rows):
                for _, score in _scores(matrix.exact, values.exact, kind):
                    score = score.ravel()
                    score = score[~np.isnan(score)]
                    counts += np.bincount(np.clip(np.trunc((score + 1) * 16) + 2, 1, 34).astype(int), minlength=35)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), pa.array(np.zeros(len(at)))], ["query_id", "col_id", "score"])

    counted = grid.cells(_vectors(queries, "query_id"), _vectors(index, "col_id"), block_bytes, ROW_BYTES).mapInArrow(run, SCHEMA)
    return counted.groupBy(F.col("query_id").cast("int").alias("bin")).agg(F.sum("col_id").alias("n"))


def pairs(queries: DataFrame, index: DataFrame, kind: str = "real") -> DataFrame:
    """All pairs with their scores, in relational form; for small inputs and as the meaning of the others."""
    joined = queries.select("query_id", F.col("vec").alias("_q")).join(index.select("col_id", F.col("vec").alias("_x")), F.size("_q") == F.size("_x"))
    if kind == "real":
        score = dna.dot("_q", "_x")
    else:
        score = F.pow(dna.rope_inner("_q", "_x")["modulus"], 2)
    return joined.select("query_id", "col_id", score.alias("score"))


def stronger_strand(best: DataFrame) -> DataFrame:
    """Of reads searched forward and reversed (read_id, strand, score, ...), the row of the higher score; forward on ties."""
    w = W.partitionBy("read_id").orderBy(F.desc("score"), "strand")
    return best.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def agreement(a: DataFrame, b: DataFrame, near: int = 18) -> DataFrame:
    """One row: mean shared places of two top-k tables, share of queries that agree wholly, share that share at least ``near``."""
    sets = lambda d, n: d.groupBy("query_id").agg(F.collect_set("col_id").alias(n))
    both = sets(a, "a").join(sets(b, "b"), "query_id").select(F.size(F.array_intersect("a", "b")).alias("n"), F.greatest(F.size("a"), F.size("b")).alias("k"))
    return both.agg(F.avg("n").alias("mean_shared"), F.avg((F.col("n") == F.col("k")).cast("double")).alias("perfect"), F.avg((F.col("n") >= near).cast("double")).alias("near"))


def minimum_by_column(rounds: DataFrame) -> DataFrame:
    """col_id, cut: each window's least score over calibration rounds (col_id, score)."""
    return rounds.groupBy("col_id").agg(F.min("score").alias("cut"))


def refine(candidates: DataFrame, reads: DataFrame, records: DataFrame, rope, margin: int) -> DataFrame:
    """read_id, rec_id, start, score: the best offset around each coarse hit.

    ``candidates`` has (read_id, rec_id, start), ``reads`` (read_id, frag) and
    ``records`` (rec_id, seq). Every offset within ``margin`` is scored; see
    ``refine_ranges``. Ties go to smaller starts.
    """
    ranges = candidates.select("read_id", "rec_id", F.lit(0).alias("strand"), F.col("start").alias("first"), F.col("start").alias("last"))
    scored = refine_ranges(ranges, reads, records, rope, margin).select("read_id", "rec_id", "start", "score")
    w = W.partitionBy("read_id").orderBy(F.desc("score"), "rec_id", "start")
    return scored.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def refine_ranges(ranges: DataFrame, reads: DataFrame, records: DataFrame, rope, margin: int) -> DataFrame:
    """read_id, rec_id, strand, start, score: the best offset within ``margin`` of each range of starts.

    ``ranges`` has (read_id, rec_id, strand, first, last); on strand 1 the read's
    reverse complement is compared, so starts are the record's on both. The score
    is the sum over frequencies of the squared modulus of the inner product with
    the read's vector; sums are updated from one offset to the next.
    """
    from .encode import Encoder

    area = F.greatest(F.lit(1), F.col("first") - margin)
    frag = F.when(F.col("strand") == 1, dna.revcomp("frag")).otherwise(F.col("frag"))
    joined = ranges.join(reads.select("read_id", "frag"), "read_id").join(records.select("rec_id", "seq"), "rec_id")
    cut = joined.select("read_id", "rec_id", "strand", area.alias("begin"), frag.alias("frag"), F.substring("seq", area, F.col("last") + margin - area + F.length("frag")).alias("area"))

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(rope)
        for frag, area in parts:
            found = [sliding(encoder, f, a) for f, a in zip(frag, area)]
            yield pd.DataFrame({"offset": [f[0] for f in found], "score": [f[1] for f in found]})

    best = F.pandas_udf(run, "offset long, score double")("frag", "area")
    scored = cut.withColumn("best", best).filter("best.offset >= 0")
    return scored.select("read_id", "rec_id", "strand", (F.col("begin") + F.col("best.offset")).cast("long").alias("start"), F.col("best.score").alias("score"))


def sliding(encoder, frag: str, area: str) -> tuple[int, float]:
    """(offset, score) of the best place of ``frag`` in ``area``; offset -1 if it does not fit.

    The product with the window at the next offset drops the leading s-mer,
    turns by one place and adds the new last s-mer.
    """
    k, n = len(frag), len(area) - len(frag) + 1
    if n < 1 or k < encoder.rope.s:
        return -1, float("-inf")
    from .encode import _CODE

    h = encoder.histogram([frag])[0]
    norm = np.sqrt((np.abs(h) ** 2).sum()) + 1e-16
    codes = _CODE[np.frombuffer(area.encode("ascii", "replace"), np.uint8)][None, :]
    slots = encoder.slots(codes)[0]
    places = k - encoder.rope.s + 1
    total = np.zeros(n)
    for i, theta in enumerate(encoder.rope.thetas()):
        # Product of the read's conjugate with each s-mer, turned by its place in the area; windows are differences of sums.
        gain = np.conj(h[slots, i]) * np.exp(1j * theta * np.arange(len(slots)))
        sums = np.concatenate(([0], np.cumsum(gain)))
        total += np.abs(sums[places:] - sums[:-places])[:n] ** 2
    total = np.round(total / norm**2, 9)
    best = int(np.argmax(total))
    return best, float(total[best])
