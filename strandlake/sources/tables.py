"""Other formats: match tables, PAF, provenance, cut vectors, indexes, truth files."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna, quant

#: Formats of an index table that ``read_index`` takes (fixed values of ours).
INDEX_FORMATS = ("strandlake.index.v1",)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (growing in file order), value."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """line, read, head, rank, strand, score, pos0, record of a match table; a line without a strand is an error.

    A block of lines is one read; ranks count within it. A header may hold
    spaces: the strand is the first bare + or - after it.
    """
    pattern = r"^(\S+)(.*?) ([+-]) (\S+) (\d+) (.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    lines = _lines(spark, path).filter(F.trim("value") != "")
    checked = F.when(F.col("value").rlike(pattern), part(1)).otherwise(F.raise_error(F.concat(F.lit("no strand in the line: "), F.col("value"))).cast("string"))
    rows = lines.select("line", F.regexp_replace(checked, "^>", "").alias("read"), F.concat(part(1), part(2)).alias("head"), part(3).alias("strand"), F.expr("try_cast(" + f"regexp_extract(value, r'{pattern}', 4) as double)").alias("score"), part(5).cast("long").alias("pos0"), F.regexp_extract(part(6), r"^>?(\S+)", 1).alias("record"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("read").orderBy("line")))


def write_maps(hits: DataFrame, path: str) -> None:
    """Match table lines of (read_id, head, rank, strand, score, start, head of the record), best first within a read."""
    line = F.concat_ws(" ", "head", F.when(F.col("strand") == 0, "+").otherwise("-"), F.format_string("%.6f", "score"), (F.col("start") - 1).cast("string"), dna.record_name("record"))
    hits.repartition("read_id").sortWithinPartitions("read_id", "rank").select(line).write.text(path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """line, qname, strand, tname, tlen, tstart of lines with at least eight columns."""
    f = F.split("value", "\t")
    number = lambda i: F.when(f[i].rlike("^-?[0-9]{1,18}$"), f[i]).cast("long")
    return _lines(spark, path).filter(F.size(f) >= 8).select("line", f[0].alias("qname"), f[4].alias("strand"), f[5].alias("tname"), number(6).alias("tlen"), number(7).alias("tstart"))


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """id, src, start, len of a provenance table; lines of fewer than three fields or without a whole start are left out; len 0 is unknown."""
    f = F.split(F.trim("value"), r"\s+")
    whole = lambda c: F.when(c.rlike("^[+-]?[0-9]{1,18}$"), c).cast("long")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^id[ \t]") & (F.size(f) >= 3))
    return rows.select(f[0].alias("id"), f[1].alias("src"), whole(f[2]).alias("start"), F.coalesce(whole(F.get(f, F.lit(3))), F.lit(0)).alias("len")).filter("start is not null")


def split_provenance(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain reads named by id, provenance table id src start len) of reads with provenance headers; others go to neither."""
    p = reads.withColumn("p", dna.provenance("head")).filter("p is not null")
    plain = p.select(F.col("p.id").alias("head"), "frag")
    return plain, p.select(F.regexp_replace("p.id", "^>", "").alias("id"), F.col("p.src").alias("src"), F.col("p.start").alias("start"), F.coalesce("p.len", F.lit(0)).alias("len"))


def write_provenance(rows: DataFrame, path: str) -> None:
    rows.select("id", "src", "start", "len").write.option("sep", " ").option("header", True).csv(path)


def read_cuts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """col_id (from 1), cut: ``n`` little-endian floats, or ``n`` numbers in text; anything else is an error."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("content").to_pylist():
                if len(data) == 4 * n:
                    values = list(struct.unpack(f"<{n}f", data))
                else:
                    values = [float(x) for x in data.split()]
                    if len(values) != n:
                        raise ValueError(f"{len(values)} cuts for {n} columns")
                yield pa.RecordBatch.from_arrays([pa.array(range(1, n + 1), pa.int64()), pa.array(values, pa.float32())], ["col_id", "cut"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "col_id long, cut float")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """name, piece, pos, reverse of a JSON file name -> {ref_index, pos, reverse}."""
    text = spark.read.option("wholetext", True).text(path)
    held = F.from_json("value", "map<string,struct<ref_index:int,pos:bigint,reverse:boolean>>")
    return text.select(F.explode(held).alias("name", "t")).select("name", F.col("t.ref_index").alias("piece"), F.col("t.pos").alias("pos"), F.col("t.reverse").alias("reverse"))


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """read_name, distance of a JSON file with a list ``distances``."""
    text = spark.read.option("wholetext", True).text(path)
    held = F.from_json("value", "distances array<struct<read_name:string,levenshtein_distance:int>>")
    return text.select(F.explode(held["distances"]).alias("d")).select(F.col("d.read_name").alias("read_name"), F.col("d.levenshtein_distance").alias("distance"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """bin_uri, nuc, processid without rows that lack any of them."""
    return spark.read.parquet(path).select("bin_uri", "nuc", "processid").na.drop()


def write_index(index: DataFrame, path: str, **parameters) -> None:
    """An index as two tables: windows, and one row of parameters."""
    spark = index.sparkSession
    index.write.parquet(f"{path}/windows")
    keys = sorted(parameters)
    spark.createDataFrame([(INDEX_FORMATS[0], *(str(parameters[k]) for k in keys))], ["format", *keys]).coalesce(1).write.parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str, **expected) -> tuple[DataFrame, dict[str, str]]:
    """(windows, parameters); an error if the format or an expected parameter differs."""
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["format"] not in INDEX_FORMATS:
        raise ValueError(f"unknown index format {meta['format']}")
    for k, v in expected.items():
        if meta.get(k) != str(v):
            raise ValueError(f"the index has {k} = {meta.get(k)}, not {v}")
    return spark.read.parquet(f"{path}/windows"), meta


def write_runs(runs: DataFrame, path: str) -> None:
    runs.select(F.col("rec_id").alias("record"), "start", "length").write.option("header", True).csv(path)


def save(value, path: str, spark: SparkSession | None = None) -> None:
    """Keeps a table, or any value that JSON has, under a path; nothing that is read back runs code."""
    if isinstance(value, DataFrame):
        value.write.parquet(f"{path}/table")
        return
    (spark or SparkSession.active()).createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{path}/value")


def load(spark: SparkSession, path: str):
    """What ``save`` kept: a DataFrame or a value."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.parquet(f"{path}/table")
    return json.loads(spark.read.text(f"{path}/value").first()["value"])


def write_split_index(index: DataFrame, path: str, **parameters) -> None:
    """An index whose vectors are kept as real and imaginary halves."""
    half = F.floor(F.size("vec") / 2).cast("int")
    parts = index.withColumn("re", F.slice("vec", F.lit(1), half)).withColumn("im", F.slice("vec", half + 1, half)).drop("vec")
    write_index(parts, path, split=True, **parameters)


def read_split_index(spark: SparkSession, path: str, **expected) -> tuple[DataFrame, dict[str, str]]:
    """(windows, parameters) of an index in halves: ``vec`` and ``turned``, whose products are a complex product's two parts."""
    parts, meta = read_index(spark, path, split=True, **expected)
    vec, turned = quant.split_complex("re", "im")
    return parts.withColumn("vec", vec).withColumn("turned", turned).drop("re", "im"), meta


def write_packed(records: DataFrame, path: str) -> None:
    """A genome at two bits a base: rec_id, head, nchar, words (16 bases each); what is no base is packed as G."""
    code = dna.codes(dna.acgt("seq"))
    records.select("rec_id", "head", F.length("seq").cast("long").alias("nchar"), dna.pack_words(code).alias("words")).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, head, nchar, seq of a packed genome."""
    seq = dna.letters(dna.unpack_words("words", F.col("nchar").cast("int")))
    return spark.read.parquet(path).select("rec_id", "head", "nchar", seq.alias("seq"))


def write_encodings(coded: DataFrame, path: str, **parameters) -> None:
    """Encoded fragments (vec, norms and what names them), with the encoder's parameters."""
    write_index(coded, path, encodings=True, **parameters)


def read_encodings(spark: SparkSession, path: str, **expected) -> tuple[DataFrame, dict[str, str]]:
    return read_index(spark, path, encodings=True, **expected)


def write_numbers(rows: DataFrame, path: str) -> None:
    """A table of numbers as CSV with a header, such as a sweep's points or an array's rows."""
    rows.write.option("header", True).csv(path)


def read_numbers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_positions(places: DataFrame, path: str, column: str = "start") -> None:
    """One position a line."""
    places.select(F.col(column).cast("string")).write.text(path)


def write_ranges(ranges: DataFrame, path: str) -> None:
    """One line for each read: its number and its ranges, piece:first-last, in order (read_id, part, piece, first, last)."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "first", "last"))), lambda r: F.concat(r["piece"].cast("string"), F.lit(":"), r["first"].cast("string"), F.lit("-"), r["last"].cast("string")))
    ranges.groupBy("read_id").agg(each.alias("r")).select(F.concat_ws(" ", F.col("read_id").cast("string"), F.array_join("r", " "))).write.text(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """read_id, part (from 1), piece, first, last of such lines."""
    f = F.split("value", " ")
    rows = spark.read.text(path).select(f[0].cast("long").alias("read_id"), F.posexplode(F.slice(f, 2, F.size(f))).alias("i", "r"))
    number = lambda i: F.regexp_extract("r", "^([0-9-]+):(-?[0-9]+)-(-?[0-9]+)$", i).cast("long")
    return rows.select("read_id", (F.col("i") + 1).alias("part"), number(1).alias("piece"), number(2).alias("first"), number(3).alias("last"))
