import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import dna, quant


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_letters_and_codes(spark):
    assert one(spark, dna.acgt("s"), s="acgtNRY-é😀xA") == "ACGTGGGGGGGA"
    assert one(spark, dna.acgt_or_a("s"), s="acNt") == "ACAT"
    assert one(spark, dna.acgt_only("s"), s="acNnx-t") == "ACGGT"
    assert one(spark, dna.iupac_to_g("s"), s="ABKMRSWYN") == "AGGGGGGGN"
    assert one(spark, dna.codes("s"), s="ACGTT") == [0, 1, 2, 3, 3]
    assert one(spark, dna.letters(dna.codes("s")), s="GATTACA") == "GATTACA"
    assert one(spark, dna.codes("s"), s="") == []
    assert one(spark, dna.revcomp("s"), s="AACGT") == "ACGTT"
    assert one(spark, dna.revcomp_codes(dna.codes("s")), s="AACGT") == [0, 1, 2, 3, 3]


def test_packing_round_trip(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(53))
    words = one(spark, dna.pack_words(dna.codes("s")), s=seq)
    want = [sum("ACGT".index(c) << (2 * j) for j, c in enumerate(seq[i : i + 16])) for i in range(0, 53, 16)]
    assert words == want
    back = dna.letters(dna.unpack_words(dna.pack_words(dna.codes("s")), 53))
    assert one(spark, back, s=seq) == seq
    assert one(spark, dna.pack_reversed(dna.codes("s")), s=seq) == one(spark, dna.pack_words(dna.codes("s")), s=seq[::-1])


def test_smers_and_scramble(spark):
    assert one(spark, dna.smer_little("s"), s="CGT") == 1 + 2 * 4 + 3 * 16
    assert one(spark, dna.smer_big("s"), s="CGT") == 1 * 16 + 2 * 4 + 3
    for s, c, lands, cleared in ((8, 4, 32, 170), (3, 2, 8, 10), (5, 5, 682, 682)):
        assert one(spark, dna.scramble(dna.smer_little("s"), c), s="G" * s) == lands
        assert 2 * (4**c - 1) // 3 == cleared


def test_provenance_forms(spark):
    heads = {
        ">read_7 start=12 len=50 src=chr 1 more": (">read_7", "chr 1 more", 12, 50),
        ">read_7 start=x len=50 src=a": None,
        ">read_7 start=12 src=a": None,
        ">NC_1.2:80:true#3": (">NC_1.2:80:true#3", "NC_1.2", 81, None),
        ">NC_1.2:80:maybe": None,
        ">a:b:c:d": None,
        "no head": None,
    }
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select("h", dna.provenance("h").alias("p")).collect()
    for r in rows:
        assert (None if r.p is None else (r.p.id, r.p.src, r.p.start, r.p.len)) == heads[r.h], r.h


def test_hash_runs_and_bins(spark):
    def brute(code):
        if len(code) < 8:
            return bytes(code + [255] * (8 - len(code))).hex()
        out = [0] * 8
        for i, c in enumerate(code):
            out[i % 8] = (out[i % 8] + c) % 256
        return bytes(out).hex()

    for n in (0, 3, 8, 19, 1000):
        code = [random.Random(n).randrange(4) for _ in range(n)]
        got = spark.createDataFrame([(code,)], "c array<int>").select(dna.dna_hash("c")).first()[0]
        assert got == brute(code)
    values = spark.createDataFrame([(x,) for x in (-5.0, -1.0, -1.01, 0.0, 1.0, 7.0, float("nan"), float("inf"))], "v double")
    assert [r[0] for r in values.select(dna.similarity_bin("v")).collect()] == [1, 2, 2, 18, 34, 34, None, 34]


def test_interpolation(spark):
    curve = [(0.0, 10.0), (1.0, 5.0), (3.0, 1.5)]
    xs = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 2.0, 3.0, 9.0)], "x double")
    assert [round(r[0], 9) for r in xs.select(dna.interpolate(curve, "x")).collect()] == [15.0, 7.5, 3.25, 1.5, 1.0]


def test_e4m3_grid(spark):
    grid = sorted({s * m * 2.0**e for s in (-1, 1) for e in range(-9, 9) for m in (range(16) if e > -9 else range(8)) if abs(m * 2.0**e) <= 448 and (m < 16)})
    xs = [random.Random(3).uniform(-500, 500) for _ in range(300)] + [random.Random(4).uniform(-0.05, 0.05) for _ in range(300)] + [0.0, 448, -1e9, 2**-10, 3 * 2**-10]
    got = quant.e4m3_numpy(np.array(xs))
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select(quant.e4m3("x")).collect()
    assert [r[0] for r in rows] == got.tolist()
    for x, q in zip(xs, got):
        assert abs(q - max(-448, min(448, x))) <= min(abs(g - max(-448, min(448, x))) for g in grid) + 1e-12
    re, im = quant.split_complex("a", "b")
    assert spark.createDataFrame([([1.0], [2.0])], "a array<double>, b array<double>").select(re, im).first()[:] == ([1.0, 2.0], [2.0, -1.0])


def test_shared_grams_and_commas(spark):
    assert one(spark, dna.shared_grams("a", "b", 3), a="ACGTACG", b="TTACGACGT") == 4
    assert one(spark, dna.comma("n"), n=1234567) == "1,234,567"
    assert spark.range(1).select(dna.hits_bucket(F.lit(11))).first()[0] == 4


def test_grams_of_any_text(spark):
    for text in ("abcdef", "aéîxyß", "a😀b😀cd", "ab", ""):
        assert one(spark, dna.grams("s", 3), s=text) == [text[i : i + 3] for i in range(len(text) - 2)]
