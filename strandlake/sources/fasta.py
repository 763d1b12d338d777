"""FASTA and FASTQ as DataFrames.

A FASTA file is read with a record separator of its own, so Spark's splits cut
it between records and every record is one row. A record begins at a ``>`` at
the start of the file or after a line end; what stands before the first one is
dropped; a ``>`` inside a line is a character like others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..shared import store_uri

def _records(spark: SparkSession, path: str, anywhere: bool = False) -> DataFrame:
    """head (verbatim, with ``>``) and seq (line ends out), the file and place, and whether the row opens a record."""
    rows = spark.read.option("lineSep", ">" if anywhere else "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # Records that a bare return ends share a row with the next one.
    marked = F.regexp_replace("value", "\r>", "\u0001>")
    parts = F.split(marked, "\u0001")
    each = rows.select("file", "block", "at", F.posexplode(parts).alias("part", "text"))
    opens = F.col("text").startswith(">") | (F.col("part") > 0)
    text = F.regexp_replace("text", "^>", "")
    head = F.regexp_extract(text, "^([^\n\r]*)", 1)
    seq = F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), "[\n\r]", "")
    return each.select("file", "block", "at", "part", opens.alias("opens"), F.concat(F.lit(">"), head).alias("head"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str, anywhere: bool = False) -> DataFrame:
    """rec_id, head, name, seq, nchar of every record, in file order; rec_id from 0 without gaps.

    ``anywhere``: a ``>`` begins a record wherever it stands, also inside a line.

    A record's number is its place within its partition, counted by the task
    that reads it, after the total of the partitions before: no sequence is
    shuffled. The totals are one row for each partition and file; they reach the
    driver and go out again as a broadcast of two numbers for each partition.
    The first row of a file that does not open a record is what stands before
    the first one, and goes.
    """
    rows = _records(spark, path, anywhere)
    counts = rows.groupBy(F.spark_partition_id().alias("pid"), "file").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "part", "opens", "block")).alias("first")).orderBy("pid").collect()
    junk = [r["first"]["at"] for r in counts if r["first"]["block"] == 0 and not r["first"]["opens"]]
    sizes: dict[int, int] = {}
    for r in counts:
        sizes[r["pid"]] = sizes.get(r["pid"], 0) + r["n"] - (r["first"]["at"] in junk)
    base, total = [], 0
    for pid, n in sorted(sizes.items()):
        base.append((pid, total))
        total += n
    if junk:
        rows = rows.filter(~(F.col("at").isin(junk) & (F.col("part") == 0)))
    # The upper bits of this number are the partition, the lower 33 the row's place in it.
    placed = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("place", 33).cast("int"))
    totals = F.broadcast(spark.createDataFrame(base, "pid int, before long"))
    rec = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(totals, "pid").select(rec.alias("rec_id"), "head", dna.record_name("head").alias("name"), "seq", F.length("seq").cast("long").alias("nchar"))


def blocks(records: DataFrame, size: int = 65_536) -> DataFrame:
    """rec_id, block, text: records cut into blocks of ``size`` characters, for ``fetch``.

    Write it sorted by rec_id and block: a scan for some places then skips the
    row groups of all others.
    """
    rest = records.select("rec_id", F.posexplode(dna.cut("seq", F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(size)), size)).alias("block", "text"))
    return rest.withColumn("block", F.col("block").cast("long"))


def fetch(held: DataFrame, places: DataFrame, size: int = 65_536) -> DataFrame:
    """``places`` (rec_id, start from 1, k) with ``frag``, the characters there; places that stand outside give what lies inside.

    Only the blocks that a place touches are joined, so a long record is not
    read for a short fragment.
    """
    first, last = F.expr(f"(start - 1) div {size}"), F.expr(f"(start + k - 2) div {size}")
    wanted = places.select("rec_id", "start", "k").distinct()
    touched = wanted.filter("k > 0 and start >= 1").withColumn("block", F.explode(F.sequence(first, last)))
    found = touched.join(held, ["rec_id", "block"]).groupBy("rec_id", "start", "k").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    cut = found.select("rec_id", "start", "k", F.substring(text, (F.col("start") - 1 - F.col("parts")[0]["block"] * size + 1).cast("int"), F.col("k").cast("int")).alias("frag"))
    return places.join(cut, ["rec_id", "start", "k"], "left").withColumn("frag", F.coalesce("frag", F.lit("")))


def reads(records: DataFrame, k: int | None = None, junk: str = "g", skip_n: bool = False, bad: str | None = None) -> DataFrame:
    """rec_id, head, frag: reads of at least ``k`` characters, cut to the first ``k``.

    ``junk``: 'g' keeps the place of what is no base as G, 'a' as A, 'drop'
    leaves it out (N stays, as G). ``skip_n`` drops reads that hold an N;
    ``bad`` 'random' gives N a base that follows from the record's number.
    """
    seq = F.col("seq")
    if skip_n:
        records = records.filter(~seq.rlike("[Nn]"))
    if bad == "random":
        seq = F.array_join(F.transform(F.split(seq, ""), lambda c, i: F.when(c.isin("N", "n"), F.substring(F.lit(dna.LETTERS), (F.pmod(F.xxhash64("rec_id", i), F.lit(4)) + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    clean: Column = {"g": dna.acgt, "a": dna.acgt_or_a, "drop": dna.acgt_only}[junk](seq)
    if k is None:
        return records.select("rec_id", "head", clean.alias("frag"))
    if junk != "drop":
        return records.filter(F.length("seq") >= k).select("rec_id", "head", F.substring(clean, 1, k).alias("frag"))
    return records.select("rec_id", "head", clean.alias("frag")).filter(F.length("frag") >= k).withColumn("frag", F.substring("frag", 1, k))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """head, seq of FASTQ records; sequences and qualities may take several lines; quality is left out.

    A quality line may begin with ``@``, so records are found in order within a
    file: one task reads a file from its begin to its end, and holds a chunk and
    a batch of records at a time. Only the files' names come from the scan. For
    a file that many tasks should share see ``pieces.read_reads``.
    """
    from .pieces import CHUNK, Lines, opened

    def run(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(store_uri(name)) as f:
                    heads, seqs, size = [], [], 0
                    for head, seq in fastq(Lines(f, 0)):
                        heads.append(head)
                        seqs.append(seq)
                        size += len(head) + len(seq)
                        if size > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(seqs, pa.string())], ["head", "seq"])
                            heads, seqs, size = [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(seqs, pa.string())], ["head", "seq"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "head string, seq string")


def fastq(lines):
    """(head, sequence) of each record of ``pieces.Lines``; as many quality characters are passed over as the sequence has."""
    text = lambda: None if (line := lines.next()) is None else line[1].decode("latin-1")
    line = text()
    while line is not None:
        if not line.startswith("@"):
            line = text()
            continue
        head, seq = line, []
        while (line := text()) is not None and not line.startswith("+"):
            seq.append(line.strip())
        sequence, passed = "".join(seq), 0
        line = text()
        while line is not None and passed < len(sequence):
            passed += len(line.strip())
            line = text()
        yield head, sequence


def load(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a file by its ending: head, seq."""
    low = path.lower()
    if low.endswith((".fq", ".fastq")):
        return read_fastq(spark, path)
    if low.endswith((".fa", ".fasta", ".fna")):
        return read_fasta(spark, path).select("head", "seq")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def keep_heads(records: DataFrame, patterns: list[str]) -> DataFrame:
    """Records whose header matches any pattern; an error if none does."""
    keep = F.lit(False)
    for p in patterns:
        keep = keep | F.col("head").rlike(p)
    kept = records.filter(keep)
    if not kept.limit(1).count():
        raise ValueError(f"no header matches {patterns}")
    return kept


def write_fasta(records: DataFrame, path: str, head: str = "head", seq: str = "seq") -> None:
    """One header line and one sequence line for each row; rows keep their order within a partition."""
    line = F.concat(F.when(F.col(head).startswith(">"), F.col(head)).otherwise(F.concat(F.lit(">"), head)), F.lit("\n"), F.col(seq))
    records.select(line).write.text(path)
