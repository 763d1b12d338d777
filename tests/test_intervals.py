"""Binned joins of places and stretches, and distances of long texts, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import edits
from strandlake.operators import intervals


def places(spark, n, seed, name, line=500):
    r = random.Random(seed)
    rows = [("one" if r.random() < 0.9 else "two", i, r.randrange(-line, line)) for i in range(n)] + [("one", n, None), (None, n + 1, 3)]
    return rows, spark.createDataFrame(rows, f"name string, {name} long, {name}_at long")


@pytest.mark.parametrize("margin", [-1, 0, 1, 17, 2000])
@pytest.mark.parametrize("hot", [3, intervals.HOT])
def test_near_is_all_pairs_within_the_margin(spark, margin, hot):
    (a, x), (b, y) = places(spark, 120, 1, "a"), places(spark, 90, 2, "b")
    got = sorted((r["name"], r["a"], r["b"]) for r in intervals.near(x, y, ["name"], "a_at", "b_at", margin, hot).collect())
    want = sorted((n, i, j) for n, i, p in a for m, j, q in b if n == m and n is not None and p is not None and q is not None and abs(p - q) <= margin)
    assert got == want


@pytest.mark.parametrize("width", [1, 10, 300])
@pytest.mark.parametrize("hot", [3, intervals.HOT])
def test_overlapping_gives_each_pair_once(spark, width, hot):
    r = random.Random(5)
    make = lambda n, s: [("one", i, p, p + r.randrange(-2, s)) for i in range(n) for p in [r.randrange(-100, 100)]]
    a, b = make(60, 30) + [("one", 99, None, 4)], make(50, 120) + [("one", 98, 4, None)]
    x, y = spark.createDataFrame(a, "name string, a long, a0 long, a1 long"), spark.createDataFrame(b, "name string, b long, b0 long, b1 long")
    got = sorted((q["a"], q["b"]) for q in intervals.overlapping(x, y, ["name"], ("a0", "b0"), ("a1", "b1"), width, hot).collect())
    whole = lambda t: [v for v in t if v[2] is not None and v[3] is not None and v[2] <= v[3]]
    assert got == sorted((p[1], q[1]) for p in whole(a) for q in whole(b) if p[2] <= q[3] and q[2] <= p[3])


def test_candidates_are_few(spark):
    """Places spread evenly over one name: the equal join makes at most three times the pairs that are near."""
    x = spark.range(4000).select(F.lit("n").alias("name"), (F.col("id") * 37 % 4001).alias("a"))
    y = x.withColumnRenamed("a", "b")
    margin = 20
    near = intervals.near(x, y, ["name"], "a", "b", margin).count()
    width = margin + 1
    bins = x.groupBy(F.floor(F.col("a") / width).alias("k")).count().withColumnRenamed("count", "n")
    other = y.select(F.explode(F.array(*(F.floor(F.col("b") / width) + i for i in (-1, 0, 1)))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    candidates = bins.join(other, "k").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert candidates <= 3 * near


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, a, n, letters):
    b = list(a)
    for _ in range(n):
        i = r.randrange(len(b) + 1)
        kind = r.randrange(3)
        if kind == 0:
            b.insert(i, r.choice(letters))
        elif i < len(b):
            b[i : i + 1] = [] if kind == 1 else [r.choice(letters)]
    return "".join(b)


def test_distances_of_many_short_pairs():
    r = random.Random(3)
    for _ in range(1500):
        letters = r.choice(["AC", "ACGT", "aäß日"])
        a = "".join(r.choice(letters) for _ in range(r.randrange(0, 60)))
        b = r.choice([changed(r, a, r.randrange(12), letters), "".join(r.choice(letters) for _ in range(r.randrange(0, 60)))])
        want = plain(a, b)
        assert edits.distance(a, b) == edits.distance(b, a, 1) == edits.distance(a, b, 2) == want


def test_bands_are_exact_up_to_their_width():
    r = random.Random(8)
    for _ in range(400):
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(1, 50)))
        b = changed(r, a, r.randrange(10), "ACGT")
        a, b = sorted((a, b), key=len)
        where = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in a}
        want = plain(a, b)
        for band in range(max(1, len(b) - len(a)), 45, 3):
            found = edits._banded(where, len(a), b, band) if a else want
            assert found == want if want <= band else found > band


def test_long_texts_match_the_built_in_function(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ACGT") for _ in range(n)) for n in (1500, 4000, 4000)]
    rows = [(i, a, b) for i, (a, b) in enumerate([(texts[0], changed(r, texts[0], 200, "ACGT")), (texts[1], texts[2]), (texts[1], texts[1]), (texts[1], ""), (None, "x"), ("", ""), (texts[1], changed(r, texts[1], 3, "ACGT"))])]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    assert [x["d"] == x["e"] for x in df.select(edits.edits("a", "b").alias("d"), F.levenshtein("a", "b").alias("e")).collect()] == [True] * len(rows)


def test_steps_follow_the_shorter_text(monkeypatch):
    """A short text against a long one takes as many steps as the short one has letters; texts that are no copies are not tried in bands first."""
    r = random.Random(4)
    steps, bands = [], []
    whole, banded = edits._whole, edits._banded
    monkeypatch.setattr(edits, "_whole", lambda where, m, b: steps.append(len(b)) or whole(where, m, b))
    monkeypatch.setattr(edits, "_banded", lambda *a: bands.append(a[3]) or banded(*a))
    texts = ["".join(r.choice("ACGT") for _ in range(n)) for n in (40, 900, 1000)]
    assert edits.distance(texts[0], texts[1]) == plain(texts[0], texts[1]) and max(steps) <= 40
    assert edits.distance(texts[2], texts[1]) == plain(texts[2], texts[1]) and max(steps) <= 900 and not bands
    many = ["".join(chr(0x4E00 + r.randrange(60)) for _ in range(n)) for n in (90, 120)]
    assert edits.distance(*many) == plain(*many)
    copy = changed(r, texts[2], 60, "ACGT")
    assert edits.distance(copy, texts[2]) == plain(copy, texts[2])


def test_bands_are_exact_beyond_their_half_width():
    r = random.Random(9)
    for _ in range(300):
        a, b = sorted(("".join(r.choice("ACG") for _ in range(r.randrange(1, 50))) for _ in range(2)), key=len)
        want, more = plain(a, b), len(b) - len(a)
        for band in range(max(1, more), 45, 3):
            found = edits._banded(edits._places(a), len(a), b, band)
            assert found >= want and (found == want or found > 2 * band + 1 - more)
