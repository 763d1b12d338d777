"""Studies of the encoding: mutation sweeps, fidelity curves, calibration, synthetic vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.edits import edits_of
from . import encode, sampling


def sweep(spark: SparkSession, rope: encode.Rope, n: int = 1000, most: float = 0.3, seed: int = 0, before: float = 0.0, shift: float = 0.0) -> DataFrame:
    """id, err, ip_re, ip_abs: a random sequence against itself mutated at rates from 0 to ``most``.

    ``before`` mutates the base once at that rate, ``shift`` moves it first.
    Every row follows from the seed and its number.
    """
    base = sampling.random_sequences(spark, n, rope.k, seed).withColumn("err", F.col("id") * most / max(1, n - 1))
    if before:
        base = base.withColumn("seq", sampling.mutated("seq", "id", before, seed + 1))
    other = sampling.mutated("seq", "id", shift, seed + 2, "shift") if shift else F.col("seq")
    both = base.withColumn("other", other).withColumn("other", sampling.mutated("other", "id", F.col("err"), seed + 3))
    pair = both.select("id", "err", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("seq").alias("frag")), F.struct(F.lit(1).alias("side"), F.col("other").alias("frag")))).alias("p"))
    coded = encode.encode(pair.select("id", "err", "p.side", "p.frag"), rope, "f64").select("id", "err", "side", "vec")
    one = coded.groupBy("id", "err").agg(F.max_by("vec", -F.col("side")).alias("a"), F.max_by("vec", "side").alias("b"))
    return one.select("id", "err", dna.rope_inner("a", "b").alias("p")).select("id", "err", F.col("p.re").alias("ip_re"), F.col("p.modulus").alias("ip_abs"))


def fidelity_curve(cloud: DataFrame, bins: int = 50) -> DataFrame:
    """fidelity, err: mean error rate by class of |product|."""
    return cloud.groupBy((F.floor(F.col("ip_abs") * bins) / bins).alias("fidelity")).agg(F.avg("err").alias("err"), F.count(F.lit(1)).alias("n"))


def prediction_error(cloud: DataFrame, curve: list[tuple[float, float]]) -> DataFrame:
    """One row: the root of the mean squared miss of the error rates that a curve predicts, in percent."""
    miss = dna.interpolate(curve, "ip_abs") - 100 * F.col("err")
    return cloud.agg(F.sqrt(F.avg(miss * miss)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def cutting_threshold(cloud: DataFrame) -> DataFrame:
    """One row: least, largest and mean |product| of the pairs."""
    return cloud.agg(F.min("ip_abs").alias("least"), F.max("ip_abs").alias("largest"), F.avg("ip_abs").alias("mean"))


def far_reads(pairs: DataFrame, most: int = 6000) -> DataFrame:
    """Rows (read, window, ...) whose edit distance is above ``most``."""
    return pairs.withColumn("distance", edits_of("read", "window", most)).filter(F.col("distance") > most)


def position_error(found: DataFrame, k: int) -> DataFrame:
    """One row: largest and mean miss of predicted positions (predicted, true), in percent of the window."""
    miss = 100 * F.abs(F.col("predicted") - F.col("true")) / F.lit(k)
    return found.agg(F.max(miss).alias("largest"), F.avg(miss).alias("mean"))


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0, unit: bool = False) -> DataFrame:
    """col_id, vec: normal vectors that follow from the seed; of length 1 if ``unit``."""
    cell = lambda i, s: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(s)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.ln(cell(i, 1))) * F.cos(2 * F.pi() * cell(i, 2)))
    rows = spark.range(n).select(F.col("id").alias("col_id"), vec.alias("vec"))
    if not unit:
        return rows
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("col_id", F.transform(F.array(F.struct("vec", norm.alias("n"))), lambda r: F.transform(r["vec"], lambda x: x / r["n"]))[0].alias("vec"))


def one_of_each(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """One row of every group, chosen by the seed and the row's key."""
    best = rows.groupBy(group).agg(F.min(F.struct(F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("k"))).alias("m")).select(group, F.col("m.k").alias(key))
    return rows.join(best, [group, key])


def substitute_at(code: Column | str, places: Column | str, values: Column | str) -> Column:
    """An array with new values at places (from 1)."""
    c, p, v = dna.col(code), dna.col(places), dna.col(values)
    return F.transform(c, lambda x, i: F.when(F.array_contains(p, i + 1), F.element_at(v, F.greatest(F.array_position(p, i + 1), F.lit(1)).cast("int"))).otherwise(x))


def delete_at(code: Column | str, places: Column | str) -> Column:
    """An array without the items at places (from 1)."""
    p = dna.col(places)
    return F.filter(dna.col(code), lambda x, i: ~F.array_contains(p, i + 1))


def insert_at(code: Column | str, places: Column | str, values: Column | str) -> Column:
    """An array with values put before the items at places (from 1 to size + 1); equal places keep their order."""
    c, p, v = dna.col(code), dna.col(places), dna.col(values)
    new = lambda i: F.transform(F.filter(F.arrays_zip(p.alias("p"), v.alias("v")), lambda z: z["p"] == i), lambda z: z["v"])
    each = F.transform(F.sequence(F.lit(1), F.size(c) + 1), lambda i: F.concat(new(i), F.slice(c, i, F.lit(1))))
    return F.flatten(each)


def nearest_rank(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` largest rows by a column, ranked; ties by all columns."""
    top = rows.orderBy(F.desc(column), *rows.columns).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(column), *rows.columns)))


def true_locus(reads: DataFrame, records: DataFrame, rope: encode.Rope) -> DataFrame:
    """read_id, distance, percent, ip_re, ip_abs: each read against the window its header names, by edits and by product.

    ``reads`` has (read_id, head, frag), ``records`` (head, seq). Reads whose
    window does not lie inside its record, or that are shorter than the
    encoder's window, are left out; only the read's first k bases count.
    """
    p = reads.select("read_id", dna.provenance("head").alias("p"), F.substring("frag", 1, rope.k).alias("frag")).filter((F.length("frag") == rope.k) & F.col("p").isNotNull())
    truth = records.select(dna.record_name("head").alias("src"), "seq")
    both = p.withColumn("src", F.col("p.src")).join(truth, "src").filter((F.col("p.start") >= 1) & (F.col("p.start") + rope.k - 1 <= F.length("seq")))
    pair = both.select("read_id", "frag", dna.acgt(F.substring("seq", F.col("p.start").cast("int"), F.lit(rope.k))).alias("window"))
    pair = pair.withColumn("distance", edits_of("frag", "window", rope.k))
    one = encode.encode(encode.encode(pair, rope, "f64").drop("norms").withColumnRenamed("vec", "a"), rope, "f64", "window").drop("norms")
    product = one.select("read_id", "distance", dna.rope_inner("a", "vec").alias("p"))
    return product.select("read_id", "distance", (100 * F.col("distance") / rope.k).alias("percent"), F.col("p.re").alias("ip_re"), F.col("p.modulus").alias("ip_abs"))
