"""Command line: ``python -m strandlake COMMAND ...``; each command is one plan."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import encode, sampling, scoring, windows
from .plans import mapping
from .server import Server
from .sources import fasta, tables

#: Indexes that this session has opened, by path.
OPENED: dict[str, tuple] = {}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, *paths: str, **options):
        q = c.add_parser(name)
        for x in paths:
            q.add_argument(x)
        for k, v in options.items():
            if isinstance(v, bool):
                q.add_argument(f"--{k}", action="store_true")
            else:
                q.add_argument(f"--{k}", type=type(v), default=v)
        return q

    rope = {"k": 20_000, "s": 5, "m": 1, "c": 5, "normalize": 0}
    add("index", "fasta", "out", kstep=2000, precision="e4m3", **rope)
    add("map", "index", "reads", "out", topk=20, precision="f32", kind="real")
    add("sample", "fasta", "out", n=1000, k=20_000, err=0.05, seed=42, draw="even", withn=False, again=False)
    add("check-sample", "fasta", "reads", k=20_000, err=0.05)
    add("verify", "provenance", "maps", k=20_000)
    add("paf", "paf", threshold=20_000)
    add("subset", "fasta", "out").add_argument("patterns", nargs="+")
    add("nruns", "fasta", "out")
    add("pool", "fasta", k=20_000)
    add("separate", "reads", "out")
    add("random", "out", n=1, length=1_000_000, seed=42)
    add("reads", "fasta", "out", n=1000, k=20_000, err=0.0, seed=42)
    add("mutate", "fasta", "out", err=0.05, seed=42, shift=False)
    add("evaluate", "fasta", kstep=2000, n=1000, err=0.05, seed=1, topk=20, **rope)
    add("convert", "source", "out")
    add("server", "commands", every=1.0)
    return p


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def opened(spark: SparkSession, path: str) -> tuple:
    """An index that stays in memory for the commands after this one."""
    if path not in OPENED:
        index, meta = tables.read_index(spark, path)
        OPENED[path] = index.cache(), meta
    return OPENED[path]


def reads_of(spark: SparkSession, path: str):
    return fasta.load(spark, path).select(F.monotonically_increasing_id().alias("read_id"), "head", dna.acgt("seq").alias("frag"))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "index":
        r = encode.Rope(a.k, a.s, a.m, a.c, a.normalize)
        tables.write_index(mapping.build_index(fasta.read_fasta(spark, a.fasta), r, a.kstep, a.precision), a.out, k=a.k, kstep=a.kstep, s=a.s, m=a.m, c=a.c, normalize=a.normalize)
    elif a.command == "map":
        index, meta = opened(spark, a.index)
        r = encode.Rope(*(int(meta[x]) for x in ("k", "s", "m", "c", "normalize")))
        reads = reads_of(spark, a.reads)
        hits = mapping.map_reads(reads, index, r, a.topk, a.kind, a.precision)
        tables.write_maps(hits.join(reads.select("read_id", "head"), "read_id"), a.out)
    elif a.command == "sample" and there(spark, a.out) and not a.again:
        print(f"{a.out} is there already")
    elif a.command == "sample":
        fasta.write_fasta(sampling.sample_reads(fasta.read_fasta(spark, a.fasta), a.n, a.k, a.err, a.seed, a.draw, not a.withn), a.out, seq="frag")
    elif a.command == "check-sample":
        sampling.verify_sample(reads_of(spark, a.reads), fasta.read_fasta(spark, a.fasta), a.k, a.err).show(truncate=False)
    elif a.command == "verify":
        if a.provenance.endswith((".fa", ".fasta")):
            prov = tables.split_provenance(reads_of(spark, a.provenance))[1]
        else:
            prov = tables.read_provenance(spark, a.provenance)
        scoring.verify_maps(tables.read_maps(spark, a.maps), prov, a.k).show(truncate=False)
    elif a.command == "paf":
        scoring.paf_stats(tables.read_paf(spark, a.paf), a.threshold).show(truncate=False)
    elif a.command == "subset":
        fasta.write_fasta(fasta.keep_heads(fasta.read_fasta(spark, a.fasta), a.patterns), a.out)
    elif a.command == "nruns":
        found = windows.n_runs(fasta.read_fasta(spark, a.fasta))
        tables.write_runs(found, a.out)
        windows.run_histogram(found).orderBy("class").show()
        windows.largest_runs(found).show()
    elif a.command == "pool":
        windows.pool_geometry(fasta.read_fasta(spark, a.fasta), a.k).orderBy(F.col("rec_id").asc_nulls_last()).show(1000)
    elif a.command == "separate":
        plain, prov = tables.split_provenance(reads_of(spark, a.reads))
        fasta.write_fasta(plain, f"{a.out}/reads", seq="frag")
        tables.write_provenance(prov, f"{a.out}/provenance")
    elif a.command == "random":
        fasta.write_fasta(sampling.random_sequences(spark, a.n, a.length, a.seed).select(F.concat(F.lit(">random_"), F.col("id").cast("string")).alias("head"), "seq"), a.out)
    elif a.command == "reads":
        fasta.write_fasta(sampling.generated_reads(fasta.read_fasta(spark, a.fasta), a.n, a.k, a.err, a.seed), a.out, seq="frag")
    elif a.command == "mutate":
        rows = fasta.read_fasta(spark, a.fasta).withColumn("seq", sampling.mutated(dna.acgt("seq"), "rec_id", a.err, a.seed, "shift" if a.shift else "edits"))
        fasta.write_fasta(rows, a.out)
    elif a.command == "evaluate":
        r = encode.Rope(a.k, a.s, a.m, a.c, a.normalize)
        _, score = mapping.sample_map_score(fasta.read_fasta(spark, a.fasta), r, a.kstep, a.n, a.err, a.seed, a.topk)
        print(scoring.result_line(score, ref=a.fasta, k=a.k, kstep=a.kstep).first()["line"])
    elif a.command == "server":
        Server(spark, a.commands, lambda words: run(spark, parser().parse_args(words))).serve(a.every)
    elif a.command == "convert":
        rows = fasta.load(spark, a.source)
        rows.write.parquet(a.out) if a.out.endswith(".parquet") else fasta.write_fasta(rows, a.out)


def main(arguments: list[str] | None = None) -> None:
    run(SparkSession.builder.appName("strandlake").getOrCreate(), parser().parse_args(arguments))


if __name__ == "__main__":
    main()
