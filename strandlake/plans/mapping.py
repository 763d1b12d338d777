"""Index building and read mapping from end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import encode, sampling, scoring, search, windows


#: Bits of a col_id below the record's number: twice a start, and the strand.
START_BITS = 33


def index_windows(records: DataFrame, k: int, kstep: int, max_records: int | None = None, start_bits: int = START_BITS) -> DataFrame:
    """col_id, rec_id, head, start, strand, frag of all windows on both strands, without an exchange.

    ``records`` has (rec_id, head, seq). col_id follows from record, start and
    strand, so any part of an index can be built again alone; a record's number
    or start beyond its bits is an error.
    """
    clean = records.select("rec_id", "head", dna.acgt("seq").alias("seq"))
    cut = windows.both_strands(windows.windows(clean, k, kstep, max_records=max_records))
    return cut.select(_col_id(start_bits).alias("col_id"), "rec_id", "head", "start", "strand", "frag")


def _col_id(start_bits: int, strand: str | Column = "strand", last: str = "start"):
    fits = F.col("rec_id").between(0, (1 << (63 - start_bits)) - 1) & (F.col(last) < (1 << (start_bits - 1)))
    number = (F.col("rec_id") * F.lit(1 << start_bits) + F.col("start") * 2 + dna.col(strand)).cast("long")
    wrong = F.raise_error(F.concat(F.lit("no bits for record "), F.col("rec_id").cast("string"))).cast("long")
    return F.when(fits, number).otherwise(wrong)


def build_index(records: DataFrame, rope: encode.Rope, kstep: int, precision: str = "f32", max_records: int | None = None, start_bits: int = START_BITS, measure=None) -> DataFrame:
    """col_id, rec_id, head, start, strand, vec (or the ``measure`` of it), norms of all windows on both strands, composed where their record lies."""
    if max_records is not None:
        records = records.filter(F.col("rec_id") < max_records)
    clean = records.select("rec_id", "head", dna.acgt("seq").alias("seq"))
    return encode.encode_windows(clean, rope, kstep, precision, measure=measure).select(_col_id(start_bits).alias("col_id"), "rec_id", "head", "start", "strand", "measure" if measure else "vec", "norms")


def encode_reads(reads: DataFrame, rope: encode.Rope, precision: str = "f32") -> DataFrame:
    """query_id, vec of reads (read_id, frag)."""
    return encode.encode(reads.select(F.col("read_id").alias("query_id"), F.substring("frag", 1, rope.k).alias("frag")).filter(F.length("frag") == rope.k), rope, precision).select("query_id", "vec")


def map_reads(reads: DataFrame, index: DataFrame, rope: encode.Rope, k: int = 20, kind: str = "real", precision: str = "f64") -> DataFrame:
    """read_id, rank, score, src, start, strand, record: each read's best windows."""
    hits = search.top_k(encode_reads(reads, rope), index, k, kind, precision)
    meta = index.select("col_id", "start", "strand", F.col("head").alias("record"), dna.record_name("head").alias("src"))
    return hits.join(meta, "col_id").withColumnRenamed("query_id", "read_id")


def map_onto(reads: DataFrame, records: DataFrame, rope: encode.Rope, kstep: int, k: int = 20, kind: str = "real", precision: str = "f32", start_bits: int = START_BITS) -> DataFrame:
    """As ``map_reads`` onto the windows of ``records``, without an index: windows are encoded where they are compared.

    The texts are shuffled once, in pieces. A hit's place is in its col_id, so hits meet the records' headers only.
    ``records`` need not be clean: what is no base is a G.
    """
    # Pieces are dealt to all tasks first: one file or one long record would be encoded by one task.
    cut = windows.pieces(records, rope.k, kstep).select(_col_id(start_bits, F.lit(0), "last").alias("col_id"), "text")
    dealt = cut.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "col_id")
    hits = search.top_k_of_pieces(encode_reads(reads, rope, precision), dealt, rope, kstep, k, kind, precision)
    place = F.col("col_id").bitwiseAND((1 << start_bits) - 1)
    hits = hits.select("*", F.shiftright("col_id", start_bits).alias("rec_id"), F.shiftright(place, 1).alias("start"), place.bitwiseAND(1).cast("int").alias("strand"))
    named = hits.join(records.select("rec_id", F.col("head").alias("record")), "rec_id")
    return named.select("col_id", F.col("query_id").alias("read_id"), "rank", "score", "start", "strand", "record", dna.record_name("record").alias("src"))


def truth_of(reads: DataFrame) -> DataFrame:
    """read_id, src, start, len from the reads' headers; unreadable headers have null src and match nothing."""
    return reads.select("read_id", dna.provenance("head").alias("p")).select("read_id", F.col("p.src").alias("src"), F.col("p.start").alias("start"), F.col("p.len").alias("len"))


def sample_map_score(records: DataFrame, rope: encode.Rope, kstep: int, n: int, err: float = 0.0, seed: int = 1, k: int = 20, mapper: Callable[..., DataFrame] = map_onto) -> tuple[DataFrame, DataFrame]:
    """(hits, one row of accuracy): reads sampled from the records themselves, mapped by ``mapper`` and scored."""
    reads = sampling.sample_reads(records, n, rope.k, err, seed)
    hits = mapper(reads, records, rope, kstep, k)
    return hits, scoring.mapping_score(hits.select("read_id", "rank", "src", "start"), truth_of(reads), rope.k)
