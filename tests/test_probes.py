import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import encode, probes


def test_sweeps_fall_with_the_error_rate(spark):
    rope = encode.Rope(400, 4, 1, 4)
    rows = probes.sweep(spark, rope, 40, 0.4, 3).orderBy("id").collect()
    assert abs(rows[0].ip_re - 1) < 1e-9 and len(rows) == 40
    assert np.corrcoef([r.err for r in rows], [r.ip_abs for r in rows])[0, 1] < -0.9
    assert probes.sweep(spark, rope, 40, 0.4, 3).orderBy("id").collect() == rows
    cloud = probes.sweep(spark, rope, 40, 0.4, 3, before=0.1, shift=0.05)
    t = probes.cutting_threshold(cloud).first()
    assert t.least <= t.mean <= t.largest <= 1 + 1e-9
    curve = [(r.fidelity, 100 * r.err) for r in probes.fidelity_curve(cloud, 10).collect()]
    assert probes.prediction_error(cloud, curve).first().rmse < 30


def test_edits_against_lists(spark):
    r = random.Random(2)
    for n in (0, 1, 9, 60):
        code = [r.randrange(4) for _ in range(n)]
        places = sorted(r.sample(range(1, n + 1), min(n, 5)))
        spots = sorted(r.randrange(1, n + 2) for _ in range(4))
        new = [r.randrange(4) for _ in range(5)]
        df = spark.createDataFrame([(code, places, new[: len(places)], spots, new[:4])], "c array<int>, p array<int>, v array<int>, q array<int>, w array<int>")
        a, b, c = df.select(probes.substitute_at("c", "p", "v"), probes.delete_at("c", "p"), probes.insert_at("c", "q", "w")).first()
        put = dict(zip(places, new))
        assert a == [put.get(i, x) for i, x in enumerate(code, 1)] and b == [x for i, x in enumerate(code, 1) if i not in places]
        want = []
        for i in range(1, n + 2):
            want += [v for s, v in zip(spots, new) if s == i] + code[i - 1 : i]
        assert c == want


def test_synthetic_vectors_and_choices(spark):
    v = np.array([r.vec for r in probes.random_vectors(spark, 300, 16, 4).collect()])
    assert abs(v.mean()) < 0.06 and abs(v.std() - 1) < 0.06
    u = np.array([r.vec for r in probes.random_vectors(spark, 20, 16, 4, unit=True).collect()])
    assert np.allclose((u**2).sum(1), 1)
    rows = spark.range(90).select((F.col("id") % 7).alias("g"), "id")
    assert probes.one_of_each(rows, "g", "id", 1).count() == 7
    far = probes.far_reads(spark.createDataFrame([("abc", "abd"), ("abc", "xyz")], "read string, window string"), 1)
    assert far.count() == 1
    assert probes.position_error(spark.createDataFrame([(1, 3), (5, 5)], "predicted long, true long"), 100).first()[:] == (2.0, 1.0)
