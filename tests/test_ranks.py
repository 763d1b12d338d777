"""Running totals over ranges against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators.ranks import running


@pytest.mark.parametrize("n", [0, 1, 500])
@pytest.mark.parametrize("down", [False, True])
def test_running_totals_with_ties_and_nulls(spark, n, down):
    r = random.Random(n)
    rows = [(i, r.choice([None, *range(40)]), r.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, x long, v long").repartition(3)
    got = {q["i"]: q["t"] for q in running(df, F.desc("x") if down else "x", "v", "t").collect()}
    key = lambda x: ((x is None), -(x or 0)) if down else ((x is not None), x or 0)
    assert got == {i: sum(w for _, y, w in rows if key(y) <= key(x)) for i, x, _ in rows}


def test_no_window_stands_without_its_partition(spark, monkeypatch, tmp_path):
    """Of 20,000 rows no task of the second step has more than a share."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        monkeypatch.setattr("strandlake.operators.ranks.fresh_path", lambda _, name: str(tmp_path / name))
        df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("x"), F.lit(1).alias("one"))
        assert running(df, "x", "one", "t").agg(F.max("t")).first()[0] == 20_000
        sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "ranges")).groupBy("_range").count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
