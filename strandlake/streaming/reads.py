"""Reads that keep arriving: map each micro-batch, and keep running totals.

Micro-batches are independent (a read's best windows need no other read), so
mapping holds no state. Totals are streaming aggregations whose state is one
row for each bin.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import dna
from ..operators import encode
from ..plans import mapping


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 64) -> DataFrame:
    """Parquet files of reads as they arrive; ``files`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def encoded(reads: DataFrame, rope: encode.Rope) -> DataFrame:
    """query_id, vec of streaming reads (read_id, frag): the batch expression, unchanged."""
    return mapping.encode_reads(reads, rope)


def start_mapping(reads: DataFrame, index: DataFrame, rope: encode.Rope, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 20, mapper: Callable[..., DataFrame] = mapping.map_reads) -> StreamingQuery:
    """Maps each micro-batch by ``mapper`` (batch, index, rope, k) and hands (hits, batch number) to ``sink``.

    The number is the same when a batch is run again, so a sink that writes
    under it counts every read once. A failing batch ends the query with its
    first error.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(mapper(rows, index, rope, k), number)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_error(queries: list[StreamingQuery], poll: float = 0.2) -> None:
    """Waits for all queries; the first that fails stops the others and its error is raised."""
    while True:
        failed = [q for q in queries if q.exception() is not None]
        if failed or not any(q.isActive for q in queries):
            for q in queries:
                q.stop()
            if failed:
                raise failed[0].exception()
            return
        time.sleep(poll)


def running_histogram(scores: DataFrame, column: str = "score") -> DataFrame:
    """bin, n over all scores so far; 34 rows of state at most."""
    return scores.groupBy(dna.similarity_bin(column).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def running_score(mapped: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row, total, correct, top1 and shared_sum, over all reads so far: a stateful count behind a stream-static join.

    ``mapped`` is a stream of reads with all of their hits, (read_id, hits:
    array of (rank, src, start)); ``truth`` (read_id, src, start, len) is a
    table that is read with each micro-batch. A read that arrives again, also
    after a restart, counts once. The state is the ids of the reads and one row.
    """
    t = truth.select(F.col("read_id"), F.col("src").alias("_src"), F.col("start").alias("_start"), F.coalesce("len", F.lit(k)).alias("_len"))
    shared = lambda h: F.least(h["start"] + k, F.col("_start") + F.col("_len")) - F.greatest(h["start"], F.col("_start"))
    right = F.filter("hits", lambda h: (h["src"] == F.col("_src")) & (shared(h) > 0))
    each = mapped.dropDuplicates(["read_id"]).join(t, "read_id").select(F.array_min(F.transform(right, lambda h: h["rank"])).alias("first"), F.array_max(F.transform(right, shared)).alias("best"))
    return each.agg(F.count(F.lit(1)).alias("total"), F.count("first").alias("correct"), F.count_if(F.col("first") == 1).alias("top1"), F.coalesce(F.sum("best"), F.lit(0)).cast("long").alias("shared_sum"))


def start_score(mapped: DataFrame, truth: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``running_score`` of what arrives in ``path``, a folder of one table for each micro-batch; the last one holds.

    A batch that is run again after a failure writes its own folder anew, so a
    query that stops anywhere goes on from its checkpoint with right counts.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running_score(mapped, truth, k).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_score(spark: SparkSession, path: str) -> DataFrame:
    """The row that ``start_score`` wrote last."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")


def running_gaps(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window, with late rows up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
