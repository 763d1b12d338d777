"""Windows over sequence positions: grids, fragments, clean pools, gap runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..shared import bounded_batches
from .ranks import running

#: Windows that are cut together; stretches that a task gathers before it hands them on; bytes of pieces that it does.
BLOCK, GATHERED, PIECES = 64, 1 << 16, 4 << 20
#: What every byte is as a base.
_BASES = bytes(ord(chr(b).upper()) if chr(b) in "ACGTacgt" else ord("G") for b in range(256))


def n_windows(nchar: Column | str, k: int, kstep: int = 1) -> Column:
    """How many windows of ``k`` a record of ``nchar`` holds on a grid of ``kstep``."""
    n = dna.col(nchar)
    return F.when(n >= k, F.floor((n - k) / kstep) + 1).otherwise(0)


def windows(records: DataFrame, k: int, kstep: int, seq: str = "seq", max_records: int | None = None) -> DataFrame:
    """One row for each window: the record's columns, ``start`` (1-based) and ``frag``.

    Windows begin at 1, 1 + kstep, ... and lie fully inside their record;
    shorter records give none. Only the window itself travels.
    """
    if max_records is not None:
        records = records.filter(F.col("rec_id") < max_records)
    rest = [c for c in records.columns if c != seq]
    # Blocks of windows first, then the windows of each block: no row holds all windows of a long record.
    span = BLOCK * kstep
    blocks = dna.cut(seq, F.sequence(F.lit(1), F.length(seq) - k + 1, F.lit(span)), span - kstep + k)
    cut = records.filter(F.length(seq) >= k).select(*rest, F.posexplode(blocks).alias("_b", "_t"))
    each = dna.cut("_t", F.sequence(F.lit(1), F.length("_t") - k + 1, F.lit(kstep)), k)
    rows = cut.select(*rest, "_b", F.posexplode(each).alias("_i", "frag"))
    return rows.select(*rest, (F.col("_b").cast("long") * span + F.col("_i") * kstep + 1).alias("start"), "frag")


def fragments(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Windows that do not overlap: floor(length / k) for each record."""
    return windows(records, k, k, seq)


def both_strands(frags: DataFrame) -> DataFrame:
    """Every window forward (strand 0) and reverse-complemented (strand 1); one pass over the input."""
    return frags.select(*[c for c in frags.columns if c != "frag"], F.posexplode(F.array("frag", dna.revcomp("frag"))).alias("strand", "frag"))


def _pieces(batches: Iterator[pa.RecordBatch], k: int, kstep: int) -> Iterator[pa.RecordBatch]:
    span = max(BLOCK, -(-k // kstep)) * kstep
    for batch in batches:
        found, held = [], 0

        def out(batch=batch):
            rows, starts, lasts, texts = zip(*found)
            return pa.RecordBatch.from_arrays([batch.column("rec_id").take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(texts, pa.binary())], ["rec_id", "start", "last", "text"])

        for i, text in enumerate(batch.column("seq").to_pylist()):
            # One byte for each character, whatever it takes elsewhere.
            text = (text or "").encode("ascii", "replace").translate(_BASES)
            for at in range(0, len(text) - k + 1, span):
                part = text[at : at + span - kstep + k]
                found.append((i, at + 1, at + 1 + (len(part) - k) // kstep * kstep, part))
                held += len(part)
                if held >= PIECES:
                    yield out()
                    found, held = [], 0
        if found:
            yield out()


def pieces(records: DataFrame, k: int, kstep: int, seq: str = "seq") -> DataFrame:
    """rec_id, start, last, text: blocks of windows in one text of bases; ``start`` and ``last`` are where the first and the last of them begin.

    The windows are those of ``windows``; what is no base is a G. Texts are cut
    in a Python task, where a letter takes a nanosecond and not the hundred of
    an expression of strings.
    """
    bounded_batches(records.sparkSession)
    kind = records.schema["rec_id"].dataType.simpleString()
    return records.select("rec_id", F.col(seq).alias("seq")).mapInArrow(lambda batches: _pieces(batches, k, kstep), f"rec_id {kind}, start long, last long, text binary")


def window_counts(records: DataFrame, k: int, kstep: int, seq: str = "seq") -> DataFrame:
    """One row: windows, records, records that hold any."""
    n = n_windows(F.length(seq), k, kstep)
    return records.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_windows"), F.count(F.lit(1)).alias("n_records"), F.count_if(F.length(seq) >= k).alias("n_kept"))


def _stretches(batches: Iterator[pa.RecordBatch], member: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of ``runs``, some texts' at a time: a batch of texts has many times its bytes in stretches."""
    for batch in batches:
        ids, starts, lengths = [], [], []

        def out(batch=batch):
            return pa.RecordBatch.from_arrays([batch.column("rec_id").take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(lengths), pa.int64())], ["rec_id", "start", "length"])

        held = 0
        for i, text in enumerate(batch.column("seq").cast(pa.large_binary())):
            text = text.as_py()
            if not text:
                continue
            data = np.frombuffer(text, np.uint8)
            inside = np.zeros(len(data) + 2, np.int8)
            inside[1:-1] = member[data]
            edge = np.diff(inside)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(first):
                # Bytes that continue a character are no places.
                place = first if text.isascii() else first - np.cumsum((data & 0xC0) == 0x80)[first]
                ids.append(np.full(len(first), i))
                starts.append(place + 1)
                lengths.append(last - first)
                held += len(first)
                if held >= GATHERED:
                    yield out()
                    ids, starts, lengths, held = [], [], [], 0
        if ids:
            yield out()


def runs(records: DataFrame, letters: str, seq: str = "seq") -> DataFrame:
    """rec_id, start (1-based), length of the maximal stretches of these ASCII letters.

    Stretches are found on the bytes of each Arrow batch and places counted in
    characters, so nothing is shuffled and a row is made for each stretch only.
    """
    member = np.zeros(256, bool)
    member[list(letters.encode())] = True

    kind = records.schema["rec_id"].dataType.simpleString()
    return records.select("rec_id", F.col(seq).alias("seq")).mapInArrow(lambda batches: _stretches(batches, member), f"rec_id {kind}, start long, length long")


def n_runs(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Maximal runs of N or n."""
    return runs(records, "Nn", seq)


def clean_runs(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Maximal runs of bases."""
    return runs(records, "ACGTacgt", seq)


def run_histogram(found: DataFrame) -> DataFrame:
    """class, runs, bases by class of run length."""
    return found.groupBy(dna.run_class("length").alias("class")).agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("bases"))


def largest_runs(found: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` longest runs, ties to earlier records and starts; ranked."""
    top = found.orderBy(F.desc("length"), "rec_id", "start").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("length"), "rec_id", "start")))


def run_quantiles(found: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row for each share: the run of that rank (nearest rank, at least the first).

    Lengths are counted first, so the ranking orders distinct lengths and not runs.
    """
    counts = found.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, "length", "n", "upto")
    upto = upto.withColumn("total", F.lit(upto.agg(F.max("upto")).first()[0]))
    rank = F.greatest(F.lit(1), F.rint(F.col("share") * F.col("total")))
    each = upto.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    return each.filter(F.col("upto") >= rank).groupBy("share").agg(F.min("length").alias("length"))


def record_stats(records: DataFrame, seq: str = "seq") -> DataFrame:
    """rec_id, length, n (N or n), other (neither base nor N), percent, runs, longest run of N."""
    hits = F.regexp_extract_all(seq, F.lit("[Nn]++"), F.lit(0))
    n = F.length(seq) - F.length(F.regexp_replace(seq, "[Nn]", ""))
    other = F.length(F.regexp_replace(seq, "[ACGTNacgtn]", ""))
    return records.select(
        "rec_id",
        F.length(seq).cast("long").alias("length"),
        n.cast("long").alias("n"),
        other.cast("long").alias("other"),
        F.when(F.length(seq) > 0, F.round(100 * n / F.length(seq), 6)).otherwise(0.0).alias("percent"),
        F.size(hits).cast("long").alias("runs"),
        F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0)).cast("long").alias("longest"),
    )


def pool(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """rec_id, first, n: stretches of starts whose windows of ``k`` hold bases only.

    A clean run of length L >= k gives the starts first .. first + L - k. The
    pool is kept as stretches; it is never made into one row for each start.
    """
    return clean_runs(records, seq).filter(F.col("length") >= k).select("rec_id", F.col("start").alias("first"), (F.col("length") - k + 1).alias("n"))


def pool_sizes(records: DataFrame, k: int, seq: str = "seq", nfree: bool = True) -> DataFrame:
    """rec_id, w: how many windows each record's pool has; records with none are absent."""
    if nfree:
        return pool(records, k, seq).groupBy("rec_id").agg(F.sum("n").alias("w"))
    return records.filter(F.length(seq) >= k).select("rec_id", (F.length(seq) - k + 1).cast("long").alias("w"))


def pool_geometry(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """For each record and in total (rec_id null): clean windows, bases, bases in runs of at least ``k``, all windows."""
    runs_ = clean_runs(records, seq).groupBy("rec_id").agg(
        F.sum(F.when(F.col("length") >= k, F.col("length") - k + 1).otherwise(0)).alias("clean"),
        F.sum("length").alias("bases"),
        F.sum(F.when(F.col("length") >= k, F.col("length")).otherwise(0)).alias("covered"),
    )
    whole = records.select("rec_id", n_windows(F.length(seq), k).cast("long").alias("raw")).join(runs_, "rec_id", "left").na.fill(0)
    return whole.rollup("rec_id").agg(*(F.sum(c).alias(c) for c in ("clean", "bases", "covered", "raw")))


def is_clean_window(seq: Column | str, start: Column, k: int) -> Column:
    """Whether the window holds bases only."""
    return ~dna.has_bad(F.substring(dna.col(seq), start, F.lit(k)))


def gram_counts(records: DataFrame, k: int, seq: str = "seq", descending: bool = True) -> DataFrame:
    """gram, n over all records, most frequent first; ties by gram."""
    counts = records.select(F.explode(dna.grams(seq, k)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "gram") if descending else counts


def select_kmers(records: DataFrame, k: int, kstep: int, seq: str = "seq") -> DataFrame:
    """col_id, piece, first_kmer, start: all windows numbered from 1 in record order, with their piece and its first window's number.

    ``(col_id - first_kmer) * kstep`` is a window's place in its piece. Numbers
    come from running totals of the records' window counts, so no window is
    sorted or shuffled.
    """
    from .sampling import running_total

    counts = records.select("rec_id", n_windows(F.length(seq), k, kstep).cast("long").alias("n")).filter("n > 0")
    first = running_total(counts, "n", "upto").select(F.col("rec_id").alias("piece"), (F.col("upto") - F.col("n") + 1).alias("first_kmer"), "n")
    each = first.select("piece", "first_kmer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return each.select((F.col("first_kmer") + F.col("i")).alias("col_id"), "piece", "first_kmer", (F.col("i") * kstep + 1).alias("start"))


def mirrored(first: Column, last: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """The bounds of a window start .. stop of a record first .. last in a stream that holds the record backwards."""
    return first + last - stop, first + last - start


def mirrored_windows(records: DataFrame, k: int, kstep: int, seq: str = "seq") -> DataFrame:
    """As ``windows``, and ``first``, ``last``: a window's bounds in its record's reverse complement, and ``there``: the text between them.

    A record is turned once and cut as ``windows`` cuts it: blocks first, then
    the windows of each block. Neither text travels with a window, so the cost
    of a record grows with its length and not with the square of it.
    """
    rest = [c for c in records.columns if c != seq]
    span = BLOCK * kstep
    size = span - kstep + k
    turned = records.select(*rest, seq, dna.revcomp(seq).alias("_r"), F.length(seq).alias("_n"))
    # No filter on the length: pushed below what makes the text, it would make it twice.
    begins = F.when(F.col("_n") >= k, F.sequence(F.lit(1), F.greatest(F.col("_n") - k + 1, F.lit(1)), F.lit(span)))
    # The last block may be shorter than the others.
    mirrors = F.transform(begins, lambda p: mirrored(F.lit(1), F.col("_n"), p, F.least(p + size - 1, F.col("_n")))[0])
    blocks = F.posexplode(F.arrays_zip(dna.cut(seq, begins, size).alias("t"), dna.cut("_r", mirrors, size).alias("r"), mirrors.alias("at")))
    cut = turned.select(*rest, "_n", blocks.alias("_b", "_z")).select(*rest, "_n", "_b", F.col("_z.t").alias("_t"), F.col("_z.r").alias("_r"), F.col("_z.at").alias("_at"))
    places = F.sequence(F.lit(1), F.length("_t") - k + 1, F.lit(kstep))
    bounds = lambda p: mirrored(F.lit(1), F.col("_n"), F.col("_b") * span + p, F.col("_b") * span + p + k - 1)
    each = F.arrays_zip(places.alias("p"), dna.cut("_t", places, k).alias("frag"), dna.cut("_r", F.transform(places, lambda p: bounds(p)[0] - F.col("_at") + 1), k).alias("there"))
    rows = cut.select(*rest, "_n", "_b", F.explode(each).alias("_w"))
    first, last = bounds(F.col("_w.p"))
    return rows.select(*rest, (F.col("_b") * span + F.col("_w.p")).cast("long").alias("start"), "_w.frag", first.cast("long").alias("first"), last.cast("long").alias("last"), "_w.there")
