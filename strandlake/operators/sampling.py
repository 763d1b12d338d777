"""Sampling reads from clean windows, and the mutation models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.edits import edits_of
from ..shared import fresh_path
from . import windows
from .ranks import running


#: Reads up to which their places are broadcast to the records.
FEW = 100_000


def even_allocation(sizes: DataFrame, n: int) -> DataFrame:
    """rec_id, w, alloc: ``n`` shared by pool size (rec_id, w), largest remainders first, ties to earlier records.

    Quotas are whole-number arithmetic. The remainders' order is over records,
    one row each.
    """
    total = sizes.agg(F.sum("w").alias("t")).first()["t"] or 0
    if not total:
        return sizes.select("rec_id", "w", F.lit(0).cast("long").alias("alloc")).limit(0)
    parts = sizes.select("rec_id", "w", F.expr(f"cast((cast(w as decimal(28,0)) * {n}) div {total} as bigint)").alias("q"), F.expr(f"cast((cast(w as decimal(28,0)) * {n}) % {total} as bigint)").alias("r"))
    left = n - (parts.agg(F.sum("q")).first()[0] or 0)
    if not left:
        return parts.select("rec_id", "w", F.col("q").alias("alloc"))
    # Remainders are counted first; ``cut`` is the one at which the last extra read is given, ``over`` how many get it there.
    upto = running(parts.groupBy("r").agg(F.count(F.lit(1)).alias("m")), F.desc("r"), "m", "upto")
    cut, over = upto.filter(F.col("upto") >= left).orderBy("upto").select("r", F.lit(left) - (F.col("upto") - F.col("m"))).first()
    tied = running_total(parts.filter(F.col("r") == cut).select("rec_id", F.lit(1).alias("one")), "one", "place").select("rec_id", "place")
    more = (F.col("r") > cut) | ((F.col("r") == cut) & (F.col("place") <= over))
    return parts.join(tied, "rec_id", "left").select("rec_id", "w", (F.col("q") + F.coalesce(more, F.lit(False)).cast("long")).cast("long").alias("alloc"))


def even_ranks(allocated: DataFrame) -> DataFrame:
    """rec_id, t, rank: midpoints of equal strata of each pool, or the pool in turn where more are drawn than it holds."""
    rows = allocated.filter("alloc > 0").select("rec_id", "w", "alloc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alloc"))).alias("t"))
    middle = F.expr("1 + ((2 * t - 1) * w) div (2 * alloc)")
    return rows.select("rec_id", "t", F.when(F.col("alloc") <= F.col("w"), middle).otherwise((F.col("t") - 1) % F.col("w") + 1).cast("long").alias("rank"))


def ranks_to_starts(ranks: DataFrame, stretches: DataFrame) -> DataFrame:
    """``ranks`` with ``start``: the rank-th start of the record's pool, kept as stretches (rec_id, first, n)."""
    w = W.partitionBy("rec_id").orderBy("first").rowsBetween(W.unboundedPreceding, 0)
    upto = stretches.withColumn("last", F.sum("n").over(w))
    joined = ranks.join(upto, "rec_id").filter((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n")))
    return joined.select(*ranks.columns, (F.col("first") + F.col("rank") - (F.col("last") - F.col("n")) - 1).cast("long").alias("start"))


def running_total(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the total of ``value`` up to and with this rec_id (a whole number)."""
    return running(rows, "rec_id", value, out)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def random_ranks(sizes: DataFrame, n: int, seed: int, buckets: int = 4096) -> DataFrame:
    """rec_id, t, rank: ``n`` draws over all pooled windows with replacement; the same for the same seed.

    Each draw is a hash of the seed and its number. Draws find their record by
    an equal join on a bucket of the running totals and a comparison within it.
    """
    total = sizes.agg(F.sum("w")).first()[0] or 0
    if not total:
        return sizes.select("rec_id", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("rank")).limit(0)
    width = -(-total // buckets)
    upto = running_total(sizes.filter("w > 0").select("rec_id", "w"), "w", "last")
    parts = upto.withColumn("b", F.explode(F.sequence(F.expr(f"(last - w) div {width}"), F.expr(f"(last - 1) div {width}"))))
    draws = sizes.sparkSession.range(1, n + 1).select(F.col("id").alias("t"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("r"))
    found = draws.withColumn("b", F.expr(f"r div {width}")).join(parts, "b").filter((F.col("r") < F.col("last")) & (F.col("r") >= F.col("last") - F.col("w")))
    return found.select("rec_id", "t", (F.col("r") - (F.col("last") - F.col("w")) + 1).cast("long").alias("rank"))


def mutate(code: np.ndarray, err: float, rng: np.random.Generator) -> np.ndarray:
    """Substitutions, deletions and insertions of ``err`` of the bases; the length stays.

    A third each of the ceil(n * err) edits are insertions and deletions, the
    rest substitutions, which always change their base.
    """
    n = len(code)
    edits = math.ceil(round(n * err, 9))
    moved = min(edits // 3, n)
    out = code.copy()
    for at in np.sort(rng.integers(0, n, edits - 2 * moved)) if n else ():
        out[at] = (code[at] + rng.integers(1, 4)) % 4
    out = np.delete(out, rng.choice(n, moved, replace=False)) if moved else out
    places = np.sort(rng.integers(0, len(out) + 1, moved)) if moved else np.zeros(0, int)
    return np.insert(out, places, rng.integers(0, 4, moved).astype(out.dtype))


def mutate_shift(code: np.ndarray, err: float, rng: np.random.Generator, shift: int | None = None) -> np.ndarray:
    """The first bases dropped (half of ``err``, or ``shift``) and as many random ones added at the end."""
    n = math.floor(len(code) * err / 2) if shift is None else shift
    return np.concatenate((code[n:], rng.integers(0, 4, min(n, len(code))).astype(code.dtype)))


_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def mutated(seq: Column | str, key: Column | str, err: Column | float, seed: int = 0, kind: str = "edits") -> Column:
    """A column of mutated sequences; each row's draws follow from ``seed`` and ``key`` alone."""
    step = {"edits": mutate, "shift": mutate_shift}[kind]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        from .encode import _CODE

        for seqs, keys, errs in parts:
            out = []
            for s, k, e in zip(seqs, keys, errs):
                if s is None:
                    out.append(None)
                    continue
                code = _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)].astype(np.uint8)
                out.append(_LETTERS[step(code, float(e), np.random.default_rng([seed & 0xFFFFFFFF, int(k) & 0xFFFFFFFFFFFFFFFF]))].tobytes().decode())
            yield pd.Series(out)

    return F.pandas_udf(run, "string")(seq, key, err if isinstance(err, Column) else F.lit(float(err)))


def random_sequences(spark, n: int, length: int, seed: int = 0) -> DataFrame:
    """id, seq: ``n`` random sequences; the same for the same seed. Eight bases come from each hash."""
    words = F.transform(F.sequence(F.lit(0), F.lit(-(-length // 8) - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4**8)))
    text = F.array_join(F.transform(words, lambda w: F.lpad(F.conv(w.cast("string"), 10, 4), 8, "0")), "")
    return spark.range(n).select("id", F.translate(F.substring(text, 1, length), "0123", dna.LETTERS).alias("seq"))


def periodic(motif: Column | str, length: int) -> Column:
    """A motif repeated to ``length``."""
    m = dna.col(motif)
    return F.substring(F.repeat(m, F.ceil(F.lit(length) / F.length(m)).cast("int")), 1, length)


def sample_reads(records: DataFrame, n: int, k: int, err: float = 0.0, seed: int = 0, draw: str = "even", nfree: bool = True) -> DataFrame:
    """read_id, head, frag, rec_id, start: ``n`` reads of ``k`` bases with their provenance.

    ``records`` has (rec_id, head, seq). Even draws need no seed for their
    places; mutations follow from the seed and the read's number.
    """
    # The texts are read once for the pools, whatever the number of steps over their sizes.
    held = written(windows.pool(records, k) if nfree else windows.pool_sizes(records, k, nfree=False), "pools")
    sizes = written(held.groupBy("rec_id").agg(F.sum("n").alias("w")), "sizes") if nfree else held
    if draw == "even":
        allocated = running_total(even_allocation(sizes, n), "alloc", "upto")
        number = allocated.select("rec_id", (F.col("upto") - F.col("alloc")).alias("before"))
        ranks = even_ranks(allocated).join(number, "rec_id").select("rec_id", "rank", (F.col("before") + F.col("t")).alias("read_id"))
    else:
        ranks = random_ranks(sizes, n, seed).withColumnRenamed("t", "read_id")
    placed = ranks_to_starts(ranks, held) if nfree else ranks.withColumn("start", F.col("rank"))
    # One small row for each read: up to so many go to the texts, not the texts to them.
    placed = F.broadcast(placed) if n <= FEW else placed
    cut = placed.join(records.select("rec_id", "head", "seq"), "rec_id").select(F.col("read_id").cast("long").alias("read_id"), "rec_id", "start", dna.read_head(F.col("read_id"), F.col("start"), k, F.col("head")).alias("head"), dna.acgt(F.substring("seq", F.col("start"), F.lit(k))).alias("frag"))
    return cut.withColumn("frag", mutated("frag", "read_id", err, seed)) if err else cut


def verify_sample(reads: DataFrame, records: DataFrame, k: int, err: float) -> DataFrame:
    """One row of counts: reads, wrong lengths, letters that are no base, unreadable headers, windows that do not exist, implausible edit rates."""
    p = reads.withColumn("p", dna.provenance("head"))
    truth = records.select(dna.record_name("head").alias("src"), F.col("seq").alias("ref"))
    joined = p.join(truth, F.col("p.src") == F.col("src"), "left").withColumn("window", dna.acgt(F.substring("ref", F.col("p.start"), F.lit(k))))
    inside = F.col("ref").isNotNull() & (F.col("p.start") >= 1) & (F.col("p.start") + k - 1 <= F.length("ref"))
    return joined.withColumn("distance", edits_of("frag", "window", k)).agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(F.length("frag") != k).alias("wrong_length"),
        F.count_if(dna.has_bad("frag")).alias("bad_letters"),
        F.count_if(F.col("p").isNull()).alias("unreadable"),
        F.count_if(F.col("p").isNotNull() & ~F.coalesce(inside, F.lit(False))).alias("outside"),
        F.count_if(inside & ~dna.edit_rate_plausible(F.col("distance"), F.lit(k), err)).alias("implausible"),
    )


def generated_reads(records: DataFrame, n: int, k: int, err: float = 0.0, seed: int = 0) -> DataFrame:
    """read_id, head, frag: ``n`` random reads of ``k`` bases anywhere in the records, mutated at ``err``; the same for the same seed."""
    return sample_reads(records, n, k, err, seed, "random", nfree=False).select("read_id", "head", "frag")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of ``a`` that ``b`` lacks, and the other way round; repeated rows count each time."""
    left, right = a.exceptAll(b).agg(F.count(F.lit(1)).alias("lacking")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("added"))
    return left.join(F.broadcast(right))
