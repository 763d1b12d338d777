"""Truth joins and the statistics of mappings."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from . import intervals
from .ranks import running


def overlap(a: Column, a_len: Column | int, b: Column, b_len: Column | int) -> Column:
    """Places that two stretches share; at most 0 if none."""
    return F.least(a + a_len, b + b_len) - F.greatest(a, b)


def truth_join(hits: DataFrame, truth: DataFrame, k: int, how: str = "inner") -> DataFrame:
    """Hits (read_id, rank, src, start) next to their read's true window (read_id, src, start, len): ``shared`` places.

    An equal join on read and record, so the range test is a residual on a
    hashed pair. A read without a length has the window's.
    """
    t = truth.select("read_id", "src", F.col("start").alias("true_start"), F.coalesce("len", F.lit(k)).alias("true_len"))
    joined = hits.join(t, ["read_id", "src"], how)
    return joined.withColumn("shared", overlap(F.col("start"), F.lit(k), F.col("true_start"), F.col("true_len"))).filter("shared > 0")


def mapping_score(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: total reads, correct ones, top1, sum and mean of the best overlaps.

    ``truth`` has every read; a read that nothing maps counts as wrong.
    """
    best = truth_join(hits, truth, k).groupBy("read_id").agg(F.min("rank").alias("first_rank"), F.max("shared").alias("best"))
    return truth.select("read_id").join(best, "read_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("first_rank").alias("correct"),
        F.count_if(F.col("first_rank") == 1).alias("top1"),
        F.coalesce(F.sum("best"), F.lit(0)).alias("shared_sum"),
        F.avg("best").alias("shared_mean"),
    )


def rank_histogram(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """rank, reads: at which rank reads have their first correct hit."""
    first = truth_join(hits, truth, k).groupBy("read_id").agg(F.min("rank").alias("rank"))
    return first.groupBy("rank").agg(F.count(F.lit(1)).alias("reads"))


def cut_score(hits: DataFrame, reads: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row on a cut search: total, correct, hits, most hits of a read, reads without."""
    counts = reads.select("read_id").join(hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("n")), "read_id", "left").na.fill(0, ["n"])
    right = truth_join(hits, truth, k).select("read_id").distinct().withColumn("right", F.lit(1))
    return counts.join(right, "read_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("right").alias("correct"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col("n") == 0).alias("without")
    )


def hit_buckets(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """bucket (1 .. 6), reads: how many hits reads have."""
    counts = reads.select("read_id").join(hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("n")), "read_id", "left").na.fill(0, ["n"])
    return counts.groupBy(dna.hits_bucket("n").alias("bucket")).agg(F.count(F.lit(1)).alias("reads"))


def verify_maps(maps: DataFrame, provenance: DataFrame, k: int) -> DataFrame:
    """One row on a match table (read, rank, record, pos0): reads, skipped, top1, correct, their percentages, mean best overlap.

    Reads without provenance are counted in ``reads`` and skipped in the rest,
    so percentages are of all reads.
    """
    reads = maps.groupBy("read").agg(F.count(F.lit(1)).alias("lines"))
    known = provenance.select(F.col("id").alias("read"), "src", F.col("start").alias("true_start"), F.when(F.col("len") > 0, F.col("len")).otherwise(k).alias("kk"))
    placed = maps.join(known, "read").filter(F.col("record") == F.col("src"))
    shared = overlap(F.col("pos0") + 1, F.col("kk"), F.col("true_start"), F.col("kk"))
    best = placed.withColumn("shared", shared).filter("shared > 0").groupBy("read").agg(F.min("rank").alias("first_rank"), F.max("shared").alias("best"))
    return reads.join(known.select("read", F.lit(1).alias("known")).distinct(), "read", "left").join(best, "read", "left").agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(F.col("known").isNull()).alias("skipped"),
        F.count_if(F.col("first_rank") == 1).alias("top1"),
        F.count("first_rank").alias("correct"),
        (100 * F.count_if(F.col("first_rank") == 1) / F.count(F.lit(1))).alias("top1_percent"),
        (100 * F.count("first_rank") / F.count(F.lit(1))).alias("correct_percent"),
        F.avg("best").alias("best_mean"),
    )


def paf_stats(paf: DataFrame, threshold: int = 20_000) -> DataFrame:
    """One row on PAF lines (line, qname, strand, tname, tstart) whose names tell the truth (seq:pos:rc): unique, top1, any."""
    parts = F.split("qname", ":")
    pos = F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(1))
    at = F.when((F.size(parts) >= 3) & pos.rlike("^-?[0-9]{1,18}$"), pos).cast("long")
    rc = F.element_at(parts, -1)
    right = (parts[0] == F.col("tname")) & (((rc == "true") & (F.col("strand") == "-")) | ((rc == "false") & (F.col("strand") == "+"))) & (F.abs(at - F.col("tstart")) < threshold)
    lines = paf.select("qname", "line", F.coalesce(right, F.lit(False)).alias("ok"))
    reads = lines.groupBy("qname").agg(F.min(F.struct("line", "ok")).alias("first"), F.bool_or("ok").alias("any"))
    return reads.agg(F.count(F.lit(1)).alias("unique"), F.count_if(F.col("first.ok")).alias("top1"), F.count_if("any").alias("any"))


def proximity(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """read_id, piece, found, true: places of the same piece that lie less than ``k`` apart."""
    t = truth.select("read_id", "piece", F.col("pos").alias("true"))
    # Places are whole numbers: less than k apart is k - 1 at most.
    return intervals.near(found.select("read_id", "piece", F.col("pos").alias("found")), t, ["read_id", "piece"], "found", "true", k - 1)


def near_locus(index: DataFrame, loci: DataFrame, margin: int) -> DataFrame:
    """Index windows (name, start, strand) of a locus' record (name, start0) within ``margin`` of it, nearest first within each locus."""
    joined = intervals.near(index, loci.select("name", "start0"), ["name"], "start", "start0", margin).withColumn("offset", F.col("start") - F.col("start0"))
    w = W.partitionBy("name", "start0").orderBy(F.abs("offset"), "strand", "offset")
    return joined.withColumn("place", F.row_number().over(w))


def merge_ranges(hits: DataFrame, k: int) -> DataFrame:
    """read_id, part, piece, first, last: neighbouring hits of one piece less than ``k`` apart become one range.

    ``hits`` has (read_id, j, piece, loc), in order j. A range also ends where
    the piece number grows; hits are compared with the one before.
    """
    w = W.partitionBy("read_id").orderBy("j")
    before, loc = F.lag("piece", 1, 0).over(w), F.lag("loc", 1, 0).over(w)
    new = (F.col("piece") > before) | (F.col("loc") - loc >= k)
    parts = hits.withColumn("part", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return parts.groupBy("read_id", "part").agg(F.min_by("piece", "j").alias("piece"), F.min_by("loc", "j").alias("first"), F.max_by("loc", "j").alias("last"))


def score_profile(hits: DataFrame) -> DataFrame:
    """rank, reads, mean, population deviation, largest score and the first read that has it."""
    stats = hits.groupBy("rank").agg(F.count(F.lit(1)).alias("reads"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.max("score").alias("largest"), F.max(F.struct("score", (-F.col("query_id")).alias("n"))).alias("_m"))
    return stats.select("rank", "reads", "mean", "deviation", "largest", (-F.col("_m.n")).alias("largest_query"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, least, largest, sample deviation."""
    (median,) = _quantiles(rows, column, (0.5,))
    return rows.agg(F.avg(column).alias("mean"), F.lit(median).cast("double").alias("median"), F.min(column).alias("least"), F.max(column).alias("largest"), F.stddev(column).alias("deviation"))


def quantiles(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """share, value: exact quantiles, linear between neighbours; null without values."""
    return rows.sparkSession.createDataFrame(list(zip(map(float, shares), _quantiles(rows, column, shares))), "share double, value double")


def _quantiles(rows: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, linear between neighbours.

    Equal values are counted first; their running totals, over ranges of equal
    size, tell which value has a wanted rank. The driver gets two values for
    each share.
    """
    counts = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, "v", "n", "upto")
    total = upto.agg(F.max("upto")).first()[0]
    if not total:
        return [None] * len(shares)
    wanted = sorted({int(r) for s in shares for r in (math.floor(s * (total - 1)), math.ceil(s * (total - 1)))})
    each = upto.select("v", "n", "upto", F.explode(F.filter(F.array(*(F.lit(r).cast("long") for r in wanted)), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    value = {r["rank"]: r["v"] for r in each.select("rank", "v").collect()}
    out = []
    for s in shares:
        p = s * (total - 1)
        a, z = value[math.floor(p)], value[math.ceil(p)]
        out.append(a + (z - a) * (p - math.floor(p)))
    return out


def group_quantile(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """group, n, mean, quantile (linear between neighbours) of each group; equal values are counted before they are put in order."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("m"))
    by = W.partitionBy(group)
    ranked = counts.withColumn("upto", F.sum("m").over(by.orderBy(value))).withColumn("all", F.sum("m").over(by)).withColumn("p", share * (F.col("all") - 1))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    found = ranked.groupBy(group).agg(F.max("all").alias("n"), (F.sum(F.col(value) * F.col("m")) / F.max("all")).alias("mean"), at(F.floor("p")).alias("a"), at(F.ceil("p")).alias("z"), F.max("p").alias("p"))
    return found.select(group, "n", "mean", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("p") - F.floor("p"))).alias("quantile"))


def decay_curve(rows: DataFrame, edit: str, score: str, width: float = 2.0, most: int = 20) -> DataFrame:
    """bin, n, mean score by classes of edit percentage; beyond the last class nothing."""
    bin_ = F.floor(F.col(edit) / width)
    return rows.withColumn("bin", bin_).filter(F.col("bin") < most).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))


#: Columns of a consensus that one row of counts holds; bytes of counts that a task gathers before it passes the fullest on; rows that meet in the first level.
COLUMNS, GATHERED, SHARES = 1024, 64 << 20, 32
_LETTERS = 27


def _squeezed(counts: np.ndarray) -> bytes:
    """A block's counts as a row holds them: most letters never occur and most columns lie behind the texts' ends."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def consensus(members: DataFrame, group: str, seq: str = "seq", default: str = "G") -> DataFrame:
    """group, n, consensus: the most frequent letter of each column, gaps and N aside; ties to the first letter; none gives ``default``.

    Letters are counted in arrays inside each task, one for each group and block
    of columns. These are added up in two levels, first among some tasks and then
    among all, a row at a time: no row and no task ever holds more than one
    block's counts besides the one it adds, however many tasks a group is in.
    Rows of counts are dealt and sorted compressed.
    """
    kind = members.schema[group].dataType.simpleString()
    member = np.full(256, 26, np.int64)
    for i in range(26):
        member[[65 + i, 97 + i]] = i
    size = 4 * COLUMNS * _LETTERS

    def tally(batches):
        held: dict = {}
        keys, part = None, TaskContext.get().partitionId()

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], keys), pa.array([b for (_, b), _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([_squeezed(c) for _, c in rows], pa.binary())], ["key", "block", "part", "counts"])

        for batch in batches:
            keys = batch.column("key").type
            for key, text in zip(batch.column("key").to_pylist(), batch.column("seq").to_pylist()):
                data = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)
                for b in range(-(-len(data) // COLUMNS)):
                    if (key, b) not in held:
                        if (len(held) + 1) * size > GATHERED:
                            # What has the most letters goes, the rest may still grow.
                            full = sorted(held.items(), key=lambda x: -int(x[1].sum()))[: len(held) // 2 + 1]
                            for at in range(0, len(full), 16):
                                yield packed(full[at : at + 16])
                            for name, _ in full:
                                del held[name]
                        held[key, b] = np.zeros(COLUMNS * _LETTERS, np.int32)
                    some = data[b * COLUMNS : (b + 1) * COLUMNS]
                    held[key, b][np.arange(len(some)) * _LETTERS + member[some]] += 1
        rest = list(held.items())
        for at in range(0, len(rest), 16):
            yield packed(rest[at : at + 16])

    def streams(batches, names):
        """Runs of equal (key, block, share) of a sorted stream: key, block, summed counts."""
        now, total = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "counts"))):
                if row[:-1] != now:
                    if now is not None:
                        yield now, total
                    now, total = row[:-1], np.zeros(COLUMNS * _LETTERS, np.int64)
                total += _widened(row[-1])
        if now is not None:
            yield now, total

    def added(batches):
        first = next(batches, None)
        if first is None:
            return
        keys = first.column("key").type
        for (key, block, _), total in streams(chain([first], batches), ("key", "block", "share")):
            yield pa.RecordBatch.from_arrays([pa.array([key], keys), pa.array([block], pa.int32()), pa.array([_squeezed(total)], pa.binary())], ["key", "block", "counts"])

    def chosen(batches):
        first = next(batches, None)
        if first is None:
            return
        keys = first.column("key").type
        for (key, block), total in streams(chain([first], batches), ("key", "block")):
            votes = total.reshape(-1, _LETTERS)
            # Columns after the last member's end have no letter at all.
            votes = votes[: int(np.flatnonzero(votes.any(1))[-1]) + 1 if votes.any() else 0, :26].copy()
            votes[:, 13] = 0  # N
            best = votes.argmax(1)
            letters = np.where(votes[np.arange(len(best)), best] > 0, best + 65, ord(default)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([key], keys), pa.array([block], pa.int32()), pa.array([letters.tobytes().decode()], pa.string())], ["key", "block", "text"])

    counts = members.select(F.col(group).alias("key"), F.col(seq).alias("seq")).mapInArrow(tally, f"key {kind}, block int, part int, counts binary")
    some = counts.withColumn("share", F.pmod("part", F.lit(SHARES))).repartition("key", "block", "share").sortWithinPartitions("key", "block", "share")
    once = some.mapInArrow(added, f"key {kind}, block int, counts binary")
    blocks = once.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(chosen, f"key {kind}, block int, text string")
    text = blocks.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("consensus"))
    sizes = members.groupBy(F.col(group).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(text, sizes["key"].eqNullSafe(text["key"]), "left").select(sizes["key"].alias(group), "n", "consensus")


def groups(members: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """group, n, members: the distinct sequences of each group, in order."""
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(seq)).alias("members"))


def numbered_groups(members: DataFrame, group: str) -> DataFrame:
    """``members`` with ``bin``: the number of their group, from 1 in the groups' order."""
    bins = members.select(group).distinct().filter(F.col(group).isNotNull())
    # One row for each group is numbered, and rows look their group up.
    numbered = running(bins.withColumn("_one", F.lit(1)), group, "_one", "bin").drop("_one")
    return members.join(numbered.withColumn("bin", F.col("bin").cast("int")), group)


def by_accession(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``hits`` (src, ...) with ``rec_id`` of the record that bears the name whole or as its accession (up to the first dot); null if none does."""
    names = records.select("rec_id", dna.record_name("head").alias("name"))
    keys = names.select("name", "rec_id").unionByName(names.select(F.substring_index("name", ".", 1).alias("name"), "rec_id")).groupBy("name").agg(F.min("rec_id").alias("rec_id"))
    return hits.join(keys.withColumnRenamed("name", "src"), "src", "left")


def without_lengths(truth: DataFrame, k: int) -> DataFrame:
    """``truth`` for a scorer that knows whole windows only: a read whose header has no length of ``k`` is an error."""
    wrong = F.raise_error(F.concat(F.lit("no length of the window's: read "), F.col("read_id").cast("string")))
    return truth.withColumn("len", F.when(F.col("len") == k, F.col("len")).otherwise(wrong.cast("long")))


def result_line(score: DataFrame, **settings) -> DataFrame:
    """line: a mapping score as one line of name=value fields, settings first."""
    fields = [F.lit(f"{n}={v}") for n, v in settings.items()]
    percent = lambda c: F.format_string("%.3f", 100 * F.col(c) / F.col("total"))
    fields += [F.concat(F.lit("reads="), F.col("total").cast("string")), F.concat(F.lit("top_pct="), percent("correct")), F.concat(F.lit("top1_pct="), percent("top1")), F.concat(F.lit("avg_bases="), F.format_string("%.1f", F.coalesce("shared_mean", F.lit(0.0))))]
    return score.select(F.concat_ws(" ", F.lit("RESULT"), *fields).alias("line"))


def retrieval_accuracy(hits: DataFrame, queries: DataFrame, ktop: int = 10) -> DataFrame:
    """rank, found, share: queries whose class is among the first ``rank`` hits. hits (query_id, rank, label), queries (query_id, label)."""
    right = hits.join(queries.select("query_id", "label"), ["query_id", "label"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    each = queries.select("query_id").join(right, "query_id", "left").select(F.explode(F.sequence(F.lit(1), F.lit(ktop))).alias("rank"), "first")
    return each.groupBy("rank").agg(F.count_if(F.col("first") <= F.col("rank")).alias("found"), F.avg(F.coalesce(F.col("first") <= F.col("rank"), F.lit(False)).cast("double")).alias("share"))


def always_found(rounds: DataFrame) -> DataFrame:
    """query_id, found: true if every round found it."""
    return rounds.groupBy("query_id").agg(F.bool_and("found").alias("found"))


#: Characters of a text up to which a pair's grams are compared in its own row.
LONG = 1 << 22


def _gram_numbers(text: np.ndarray, n: int) -> np.ndarray:
    """A number for each n-gram of an array of characters, equal where the grams are: halves are numbered, then put together."""
    number, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < n:
        if int(number.max(initial=0)) >= 1 << 31:
            number = np.unique(number, return_inverse=True)[1].astype(np.int64)
        step = min(width, n - width)
        number = number[: len(number) - step] * (int(number.max(initial=0)) + 1) + number[step:]
        width += step
    return number


def _shared(a: str | None, b: str | None, n: int) -> int:
    if min(len(a or ""), len(b or "")) < n:
        return 0
    # Grams that lie across the end of ``a`` are left out again.
    numbers = _gram_numbers(np.frombuffer((a + b).encode("utf-32-le"), np.uint32), n)
    return int(np.isin(numbers[len(a) :], numbers[: len(a) - n + 1]).sum())


def shared_gram_counts(pairs: DataFrame, n: int = 16) -> DataFrame:
    """pair_id, shared: how many n-gram places of ``b`` hold an n-gram of ``a``, for (pair_id, a, b).

    A pair is compared where its row lies, so no gram is shuffled. Pairs with a
    text of more than LONG characters, and rows that share their pair_id, meet
    gram by gram in a semi-join, which costs their length and no task's memory.
    """

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            yield pa.array([_shared(x.as_py(), y.as_py(), n) for x, y in zip(a, b)], pa.int64())

    alone = (F.count(F.lit(1)).over(W.partitionBy("pair_id")) == 1) & F.col("pair_id").isNotNull()
    rows = pairs.select("pair_id", "a", "b", (alone & (F.greatest(F.length("a"), F.length("b"), F.lit(0)) <= LONG)).alias("_short"))
    short, rest = rows.filter("_short"), rows.filter("not _short")
    near = short.select("pair_id", F.arrow_udf(run, "long")("a", "b").alias("shared"))
    known = rest.select("pair_id", F.explode(F.array_distinct(dna.grams("a", n))).alias("gram"))
    places = rest.select("pair_id", F.explode(dna.grams("b", n)).alias("gram"))
    counts = places.join(known, ["pair_id", "gram"], "left_semi").groupBy("pair_id").agg(F.count(F.lit(1)).alias("shared"))
    return near.unionByName(rest.select("pair_id").join(counts, "pair_id", "left").na.fill(0, ["shared"]))


def least_or(rows: DataFrame, names: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """key, value of every name: the least value of its rows, or ``default``."""
    least = rows.groupBy(key).agg(F.min(value).alias(value))
    return names.select(key).distinct().join(least, key, "left").na.fill(default, [value])


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that were asked for and are not there."""
    return wanted.select(key).distinct().join(found, key, "left_anti")
