"""Rotary-phase histograms of s-mers ("rope" vectors).

Each s-mer of a sequence adds a unit vector to its bin, turned by an angle that
grows with its place. ``encode_long`` says that in relational form;
``encode`` computes it for Arrow batches and is what plans use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.quant import e4m3_numpy


@dataclass(frozen=True)
class Rope:
    """Encoder parameters: window length, s-mer length, frequencies, compacted length; and variants.

    ``order``: which end of an s-mer has the low bits ('little' or 'big').
    ``scramble``: fold s-mers by the golden ratio; else the s-mer's number is the bin (c >= s).
    ``phase``: turn by place; else plain counts. ``zero_g``: clear the bin of an all-G c-mer.
    ``frequencies``: 'spread' is 1 .. 3 evenly, 'whole' is 1 .. m.
    ``normalize``: 0 one norm, 1 one for each frequency, 2 unit bins, 3 root bins; -1 none.
    """

    k: int
    s: int = 5
    m: int = 1
    c: int = 5
    normalize: int = 0
    order: str = "little"
    scramble: bool = True
    phase: bool = True
    zero_g: bool = True
    frequencies: str = "spread"

    def __post_init__(self):
        if not (0 < self.s <= 16 and 0 < self.c <= self.s or not self.scramble and self.c >= self.s > 0) or self.m < 1 or self.k < self.s:
            raise ValueError(f"no such encoder: {self}")

    @property
    def dim(self) -> int:
        return self.m * 4**self.c

    @property
    def all_g(self) -> int:
        """The slot, from 0, of a c-mer of Gs."""
        return 2 * (4**self.c - 1) // 3

    def thetas(self) -> list[float]:
        turns = [1.0] if self.m == 1 and self.frequencies == "spread" else [2 * i / (self.m - 1) + 1 for i in range(self.m)] if self.frequencies == "spread" else [i + 1.0 for i in range(self.m)]
        return [t * 2 * math.pi / self.k for t in turns]

    #: Guards of the norms by mode (fixed values).
    GUARDS = {0: 1e-16, 1: 1e-7, 2: 2.220446049250313e-16, 3: 2.220446049250313e-16}


def encode_long(frags: DataFrame, rope: Rope, key: str | list[str] = "id") -> DataFrame:
    """key, bin, re, im (before normalising) of ``frags`` (key, frag); bins from 0, frequency innermost. Several plain columns as a key are summed faster than one struct.

    Null and short sequences have no rows; what is no base is a G. Sequences are
    dealt by their key once, before one row for each s-mer is made of them: no
    s-mer and no bin is shuffled. All frequencies are summed in one row.
    """
    keys = [key] if isinstance(key, str) else key
    partitions = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Digits of base 4, as bytes, whose places need no search; turned round once for the whole sequence where an s-mer's first base is its lowest digit.
    little = rope.order == "little"
    digits = F.translate(dna.acgt("frag"), dna.LETTERS, "0123")
    texts = frags.filter(F.length("frag") >= rope.s).select(*keys, (F.reverse(digits) if little else digits).cast("binary").alias("_t")).repartition(partitions, *keys)
    last = F.length("_t") - rope.s
    places = texts.select(*keys, "_t", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    number = F.conv(F.substring("_t", (last - F.col("p") if little else F.col("p")) + 1, F.lit(rope.s)).cast("string"), 4, 10).cast("long")
    smers = places.select(*keys, "p", number.alias("_n"))
    number = F.col("_n")
    slots = smers.select(*keys, "p", (dna.scramble(number, rope.c) if rope.scramble else number).alias("slot"))
    angles = [F.col("p") * F.lit(t) if rope.phase else F.lit(0.0) for t in rope.thetas()]
    sums = slots.groupBy(*keys, "slot").agg(*(f(a).alias(f"_{n}{i}") for i, a in enumerate(angles) for n, f in (("re", lambda a: F.sum(F.cos(a))), ("im", lambda a: F.sum(F.sin(a))))))
    if rope.zero_g:
        sums = sums.filter(F.col("slot") != rope.all_g)
    turn = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_re{i}").alias("re"), F.col(f"_im{i}").alias("im")) for i in range(rope.m))))
    return sums.select(*keys, "slot", turn.alias("f")).select(*keys, (F.col("slot") * rope.m + F.col("f.i")).alias("bin"), "f.re", "f.im")


def normalize_long(bins: DataFrame, rope: Rope, key: str = "id") -> DataFrame:
    """``encode_long``'s rows with normalised re and im, and the norm that each was divided by."""
    guard = Rope.GUARDS.get(rope.normalize, 0.0)
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    if rope.normalize in (2, 3):
        by = size + guard if rope.normalize == 2 else F.sqrt(size + guard)
        bins = bins.select(key, "bin", (F.col("re") / by).alias("re"), (F.col("im") / by).alias("im"))
    if rope.normalize < 0:
        return bins.withColumn("norm", F.lit(1.0))
    group = [key] if rope.normalize == 0 else [key, F.col("bin") % rope.m]
    from pyspark.sql import Window as W

    norm = F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2).over(W.partitionBy(*group))) + guard
    return bins.withColumn("norm", norm).withColumn("re", F.col("re") / F.col("norm")).withColumn("im", F.col("im") / F.col("norm"))


_CODE = np.full(256, 2, np.int64)
for _c, _l in enumerate("ACGT"):
    _CODE[ord(_l)] = _CODE[ord(_l.lower())] = _c
#: Places that are summed together, so few that they stay in a core's cache.
PLACES = 1 << 16


class Encoder:
    """Encodes many sequences of one length at once; tables are made once for a worker."""

    def __init__(self, rope: Rope):
        self.rope = rope
        self.phases: dict[int, np.ndarray] = {}
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def _phases(self, n: int) -> np.ndarray:
        if n not in self.phases:
            t = np.array(self.rope.thetas())[:, None] * np.arange(n)[None, :] if self.rope.phase else np.zeros((self.rope.m, n))
            self.phases[n] = np.exp(1j * t)
        return self.phases[n]

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """(rows, places) of bins of c-mers, from (rows, length) codes."""
        s, c = self.rope.s, self.rope.c
        n = codes.shape[1] - s + 1
        number = np.zeros((len(codes), n), np.int64)
        for j in range(s):
            number += codes[:, j : j + n] << (2 * (j if self.rope.order == "little" else s - 1 - j))
        if not self.rope.scramble:
            return number
        mask = 4**c - 1
        return (number & mask) ^ (((number >> (2 * c)) * dna.GOLDEN) & dna.WRAP & mask)

    def histogram(self, frags: list[str]) -> np.ndarray:
        """(rows, slots, m) complex sums of sequences of one length, before normalising."""
        rope = self.rope
        codes = _CODE[np.frombuffer("".join(frags).encode("ascii", "replace"), np.uint8)].reshape(len(frags), -1)
        out = np.zeros((len(frags), 4**rope.c, rope.m), complex)
        if codes.shape[1] < rope.s:
            return out
        slot = self.slots(codes)
        flat = (slot + np.arange(len(frags))[:, None] * 4**rope.c).ravel()
        size = len(frags) * 4**rope.c
        for i, turn in enumerate(self._phases(slot.shape[1])):
            weight = np.broadcast_to(turn, slot.shape)
            out[:, :, i] = (np.bincount(flat, weight.real.ravel(), size) + 1j * np.bincount(flat, weight.imag.ravel(), size)).reshape(len(frags), -1)
        if rope.zero_g:
            out[:, rope.all_g, :] = 0
        return out

    def sums(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(real, imaginary) sums (rows, slots, m) of (rows, places) of bins, some rows at a time: those of ``histogram``."""
        rope, (rows, n), size = self.rope, slot.shape, 4**self.rope.c
        out = np.empty((rows, size, rope.m)), np.empty((rows, size, rope.m))
        step = max(1, min(rows, PLACES // n))
        base = np.arange(step)[:, None] * size
        turns = [(np.tile(t.real, step), np.tile(t.imag, step)) for t in self._phases(n)]
        for at in range(0, rows, step):
            part = slot[at : at + step]
            flat = (part + base[: len(part)]).ravel()
            for i, turn in enumerate(turns):
                for half, weight in zip(out, turn):
                    half[at : at + step, :, i] = np.bincount(flat, weight[: len(flat)], len(part) * size).reshape(len(part), size)
        if rope.zero_g:
            for half in out:
                half[:, rope.all_g, :] = 0
        return out

    def vectors(self, slot: np.ndarray) -> np.ndarray:
        """The vectors of windows whose bins are ``slot``: those of their texts one by one."""
        re, im = self.sums(slot)
        flat = normalized(re + 1j * im, self.rope.normalize)[0].reshape(len(slot), self.rope.dim)
        return np.concatenate((flat.real, flat.imag), axis=1)

    def rough(self, slot: np.ndarray) -> np.ndarray:
        """As ``vectors`` of one norm, in single precision: four roundings away from it at most."""
        halves = [x.reshape(len(slot), self.rope.dim) for x in self.sums(slot)]
        norm = np.sqrt(sum(np.einsum("ij,ij->i", x, x) for x in halves)) + Rope.GUARDS[0]
        out = np.empty((len(slot), 2 * self.rope.dim), np.float32)
        for at, x in zip((0, self.rope.dim), halves):
            np.multiply(x, (1 / norm)[:, None], out=out[:, at : at + self.rope.dim], casting="same_kind")
        return out

    def strand_slots(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bins at each place of one text of codes (bytes): of the s-mer there, and of its reverse complement."""
        s = self.rope.s
        if s > 8:
            wide = codes[None, :].astype(np.int64)
            return self.slots(wide)[0], self.reversed_slots(wide)[0]
        if self.tables is None:
            digits = np.arange(4**s)[:, None] >> 2 * np.arange(s)[None, :] & 3
            self.tables = self.slots(digits)[:, 0].astype(np.int32), self.reversed_slots(digits)[:, 0].astype(np.int32)
        n = max(0, len(codes) - s + 1)
        number, wide = np.zeros(n, np.uint16), codes.astype(np.uint16)
        for j in range(s):
            number |= wide[j : j + n] << np.uint16(2 * j)
        return self.tables[0][number], self.tables[1][number]

    def places(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each strand the bins of the windows that begin at each place of one text of codes (bytes), in the order of the window's text; nothing is copied."""
        n = self.rope.k - self.rope.s + 1
        forward, back = (np.lib.stride_tricks.sliding_window_view(slot, n) if len(slot) >= n else np.zeros((0, n), np.int64) for slot in self.strand_slots(codes))
        return [forward, back[:, ::-1]]

    def reversed_slots(self, codes: np.ndarray) -> np.ndarray:
        """As ``slots``, of the reverse complement of the s-mer at each place."""
        return self.slots(3 - codes[:, ::-1])[:, ::-1]

    def composed(self, codes: np.ndarray, kstep: int, strands: tuple[int, ...] = (0, 1)) -> Iterator[tuple[int, int, np.ndarray]]:
        """(strand, first window, (windows, slots, m) sums) of the windows at 0, kstep, ... of one text, some windows at a time.

        Each place of the text is added once for a strand, to the histogram of
        its stretch of ``kstep`` places. A window is the sum of the stretches it
        covers, each turned by its distance, and of the head of the last one. On
        the other strand an s-mer has another slot and its place counts from the
        window's end, so the sum is the conjugate, turned once more.
        """
        rope = self.rope
        size, n = 4**rope.c, rope.k - rope.s + 1
        windows = (len(codes) - rope.k) // kstep + 1 if len(codes) >= rope.k else 0
        full, rest = divmod(n, kstep)
        thetas = rope.thetas() if rope.phase else [0.0] * rope.m
        some = max(1, min(windows, (1 << 22) // (size * rope.m)))
        for first in range(0, windows, some):
            w = min(some, windows - first)
            part = codes[None, first * kstep : (first + w - 1) * kstep + rope.k]
            place = np.arange((w - 1) * kstep + n)
            within, stretch = place % kstep, place // kstep
            whole, head = stretch < w + full - 1, (within < rest) & (stretch >= full)
            for strand in strands:
                slot = (self.reversed_slots if strand else self.slots)(part)[0]
                out = np.empty((w, size, rope.m), complex)
                for i, theta in enumerate(thetas):
                    turn = np.exp(1j * theta * np.arange(kstep))

                    def sums(keep: np.ndarray, base: int, rows: int, turn=turn, slot=slot) -> np.ndarray:
                        at, t = (stretch[keep] - base) * size + slot[keep], turn[within[keep]]
                        return (np.bincount(at, t.real, rows * size) + 1j * np.bincount(at, t.imag, rows * size)).reshape(rows, size)

                    h = np.zeros((w, size), complex)
                    if full:
                        upto = np.zeros((w + full, size), complex)
                        np.cumsum(sums(whole, 0, w + full - 1) * np.exp(1j * theta * kstep * np.arange(w + full - 1))[:, None], axis=0, out=upto[1:])
                        h = (upto[full:] - upto[:w]) * np.exp(-1j * theta * kstep * np.arange(w))[:, None]
                    if rest:
                        h += sums(head, full, w) * np.exp(1j * theta * kstep * full)
                    out[:, :, i] = np.conj(h) * np.exp(1j * theta * (n - 1)) if strand else h
                if rope.zero_g:
                    out[:, rope.all_g, :] = 0
                yield strand, first, out

    def __call__(self, frags: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((rows, 2 * dim) split vectors, (rows, m) norms); sequences may differ in length."""
        rope = self.rope
        vectors, norms = np.zeros((len(frags), 2 * rope.dim)), np.zeros((len(frags), rope.m))
        by_length: dict[int, list[int]] = {}
        for i, f in enumerate(frags):
            by_length.setdefault(len(f or ""), []).append(i)
        for n, rows in by_length.items():
            step = max(1, (1 << 22) // max(1, n, 4**rope.c * rope.m))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                h = self.histogram([frags[i] or "" for i in some])
                h, norms[some] = normalized(h, rope.normalize)
                flat = h.reshape(len(some), -1)
                vectors[some] = np.concatenate((flat.real, flat.imag), axis=1)
        return vectors, norms


def normalized(h: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """(histograms, norms) of (rows, slots, m) sums. Mode 0 has its one norm first and zeros after it."""
    norms = np.zeros((len(h), h.shape[2]))
    if mode < 0:
        return h, norms + 1
    guard = Rope.GUARDS[mode]
    if mode in (2, 3):
        size = np.abs(h) + guard
        h = h / (size if mode == 2 else np.sqrt(size))
    power = np.abs(h) ** 2
    if mode == 0:
        norm = np.sqrt(power.sum((1, 2))) + guard
        norms[:, 0] = norm
        return h / norm[:, None, None], norms
    norms = np.sqrt(power.sum(1)) + guard
    return h / norms[:, None, :], norms


def encode(frags: DataFrame, rope: Rope, precision: str = "f32", column: str = "frag") -> DataFrame:
    """``frags`` with ``vec`` (array<float>, [re.., im..]) and ``norms`` in place of the sequence.

    ``precision``: 'f64' and 'f32' store as computed, 'f16' and 'e4m3' round to
    those grids. The other columns never leave the JVM.
    """
    kind = {"f64": "double"}.get(precision, "float")
    round_ = {"f16": lambda v: v.astype(np.float16).astype(np.float32), "e4m3": e4m3_numpy}.get(precision, lambda v: v)

    item = pa.float64() if kind == "double" else pa.float32()

    def lists(values: np.ndarray, of: pa.DataType) -> pa.Array:
        offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), of))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(rope)
        for part in parts:
            vectors, norms = encoder(part.to_pylist())
            yield pa.StructArray.from_arrays([lists(round_(vectors), item), lists(norms, pa.float64())], ["vec", "norms"])

    udf = F.arrow_udf(run, f"vec array<{kind}>, norms array<double>")
    return frags.withColumn("_e", udf(column)).select(*[c for c in frags.columns if c != column], F.col("_e.vec").alias("vec"), F.col("_e.norms").alias("norms"))


def with_bins(coded: DataFrame, vec: str = "vec") -> DataFrame:
    """Encoded rows that have any bin, as in ``encode_long``: a sequence whose s-mers all fold into the cleared slot has no direction and no row."""
    return coded.filter(F.exists(vec, lambda x: x != 0))


def encode_windows(records: DataFrame, rope: Rope, kstep: int, precision: str = "f32", seq: str = "seq", measure: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The columns of ``records`` without the sequence, and start, strand, vec, norms of all windows on both strands.

    ``measure`` gives a number for each row of a matrix of vectors; it then stands
    in place of ``vec``, as ``measure``, and no vector leaves its task.

    The same rows as cutting, turning and encoding every window by itself, at a
    cost that does not grow with their overlap; a long record is cut into blocks
    of windows first, so nothing is shuffled and no row holds a whole record.
    """
    from .windows import BLOCK

    kind = {"f64": "double"}.get(precision, "float")
    item = pa.float64() if kind == "double" else pa.float32()
    round_ = {"f16": lambda v: v.astype(np.float16).astype(np.float32), "e4m3": e4m3_numpy}.get(precision, lambda v: v)
    rest = [c for c in records.columns if c != seq]
    # Blocks as long as a window at least: what they share is read twice at most.
    span = max(BLOCK, -(-rope.k // kstep)) * kstep
    cut = records.filter(F.length(seq) >= rope.k).select(*rest, F.posexplode(dna.cut(seq, F.sequence(F.lit(1), F.length(seq) - rope.k + 1, F.lit(span)), span - kstep + rope.k)).alias("_b", "_t"))
    fields = ", ".join(f"`{c}` {t}" for c, t in records.select(*rest).dtypes)

    def lists(values: np.ndarray, of: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rope)
        for batch in batches:
            for row, (block, text) in enumerate(zip(batch.column("_b").to_pylist(), batch.column("_t").to_pylist())):
                codes = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                for strand, first, sums in encoder.composed(codes, kstep):
                    h, norms = normalized(sums, rope.normalize)
                    flat = h.reshape(len(h), -1)
                    n = len(h)
                    start = block * span + (first + np.arange(n)) * kstep + 1
                    split = round_(np.concatenate((flat.real, flat.imag), axis=1))
                    vec = pa.array(measure(split), pa.float64()) if measure else lists(split, item)
                    own = [batch.column(c).take(pa.array(np.full(n, row))) for c in rest]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int64()), pa.array(np.full(n, strand, np.int32)), vec, lists(norms, pa.float64())], [*rest, "start", "strand", name, "norms"])

    name, type_ = ("measure", "double") if measure else ("vec", f"array<{kind}>")
    return cut.mapInArrow(run, f"{fields}, start long, strand int, {name} {type_}, norms array<double>")


def centroids(vectors: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """group, n, vec: the sum of each group's vectors, brought to length 1."""
    long = vectors.select(group, F.posexplode(vec).alias("i", "x"))
    sums = long.groupBy(group, "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    return whole.select(group, "n", F.transform("v", lambda e: e["x"] / (F.col("norm") + 1e-16)).alias("vec"))
