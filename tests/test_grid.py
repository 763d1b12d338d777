"""The block grid and the common floor against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import grid, search


def tables(spark, n_queries, n_rows, dim=8, seed=0, parts=7):
    r = np.random.default_rng(seed)
    q, x = r.integers(-3, 4, (n_queries, dim)).astype(float), r.integers(-3, 4, (n_rows, dim)).astype(float)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(9_999, None)], "query_id long, vec array<double>")
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9_999, None)], "col_id long, vec array<double>").repartition(parts)
    return queries, index, q @ x.T


def best(scores, k):
    out = []
    for i, row in enumerate(scores):
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out += [(i, n, int(c), float(row[c])) for n, c in enumerate(order, 1)]
    return out


def rows(df):
    return sorted((r["query_id"], r["rank"], r["col_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("broadcast", [0, grid.BROADCAST])
def test_both_ways_through_the_grid_give_all_pairs(spark, monkeypatch, broadcast):
    queries, index, scores = tables(spark, 60, 150)
    monkeypatch.setattr(grid.cells, "__defaults__", (600, 1500, broadcast))
    assert rows(search.top_k(queries, index, 5, block_bytes=600)) == best(scores, 5)
    above = {(r["query_id"], r["col_id"]) for r in search.above_cuts(queries, index, 20.0, block_bytes=600).collect()}
    assert above == {(int(q), int(c)) for q, c in zip(*np.nonzero(scores > 20))}
    least = {r["col_id"]: r["cut"] for r in search.least_by_column(queries, index, block_bytes=600).collect()}
    assert least == {c: float(s) for c, s in enumerate(scores.min(0))}
    plan = search.above_cuts(queries, index, 20.0, block_bytes=600)._jdf.queryExecution().toString()
    assert ("x_group" in plan) != bool(broadcast) and "NestedLoop" not in plan and "Cartesian" not in plan


def test_fewer_rows_than_k_and_empty_sides(spark):
    queries, index, scores = tables(spark, 3, 4)
    assert rows(search.top_k(queries, index, 10)) == best(scores, 10)
    assert search.top_k(queries.limit(0), index, 3).count() == 0 and search.top_k(queries, index.limit(0), 3).count() == 0


def test_the_floor_lets_few_rows_through(spark, monkeypatch, tmp_path):
    """Of 64 parts with k rows a query each, at most 2k a query are sent in the second round."""
    queries, index, scores = tables(spark, 40, 6400, dim=24, seed=3, parts=64)
    monkeypatch.setattr(grid, "fresh_path", lambda _, name: str(tmp_path / name))
    k, queries = 20, queries.coalesce(1)
    assert rows(search.top_k(queries, index, k)) == best(scores, k)
    floor = np.frombuffer(spark.read.parquet(str(tmp_path / "floors")).first()["floor"])
    parts = [grid.Lists.read(r["data"]) for r in spark.read.parquet(str(tmp_path / "partials")).collect()]
    sent = np.zeros(40, int)
    for _, counts, _, score in parts:
        sent += np.bincount(np.repeat(np.arange(40), counts)[score >= np.repeat(floor, counts)], minlength=40)
    assert len(parts) == 64 and (sent >= k).all() and sent.mean() <= 2 * k


def test_jobs_do_not_grow_with_the_queries(spark):
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (10, 400):
        queries, index, _ = tables(spark, n, 50)
        spark.sparkContext.setJobGroup(f"grid-{n}", "")
        search.top_k(queries, index, 3, block_bytes=500).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"grid-{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_lists_keep_ties_by_column_and_leave_out_what_is_no_number():
    lists = grid.Lists(np.array([7]), 2)
    lists.add(np.array([5, 1, 9, 2]), np.array([[1.0, 1.0, np.nan, 0.5]]))
    ids, counts, where, score = grid.Lists.read(lists.above(np.array([1.0])))
    assert (ids.tolist(), counts.tolist(), where.tolist(), score.tolist()) == ([7], [2], [1, 5], [1.0, 1.0])
    other = grid.Lists(np.array([7]), 2)
    other.add(np.array([0, 4]), np.array([[1.0, 3.0]]))
    other.take(lists.above(np.array([-np.inf])))
    assert other.where.tolist() == [[4, 0]]


def test_blocks_are_sent_as_often_whatever_their_number(spark, monkeypatch):
    """What is dealt grows with the input: each block goes to as many groups for 60 blocks of queries as for 6."""
    import re

    monkeypatch.setattr(grid.cells, "__defaults__", (600, 1500, 0))
    copies = []
    for n in (60, 600):
        queries, index, scores = tables(spark, n, 150)
        found = search.above_cuts(queries, index, 20.0, block_bytes=600)
        assert found.count() == (scores > 20).sum()
        copies.append(re.findall(r"explode\(sequence\(cast\(0 as bigint\), cast\((\d+) as bigint\)", found._jdf.queryExecution().analyzed().toString()))
    assert copies[0] == copies[1] == ["2", "2"]


def test_scores_come_in_small_tiles():
    r = np.random.default_rng(1)
    q, x = r.normal(size=(2 * search.TILE_QUERIES + 5, 8)), r.normal(size=(search.TILE, 8))
    real, turned = q @ x.T, q @ np.concatenate((x[:, 4:], -x[:, :4]), 1).T
    for kind, want in (("real", real), ("complex", real**2 + turned**2), ("abs", np.sqrt(real**2 + turned**2))):
        got = np.full(real.shape, np.nan)
        for of, score in search._scores(q, x, kind):
            assert score.size <= search.TILE_QUERIES * search.TILE
            got[of] = score
        np.testing.assert_allclose(got, want, atol=2e-12)


def test_full_lists_of_some_queries_take_ties_by_column():
    r = np.random.default_rng(2)
    score, where = r.integers(0, 6, (9, 400)).astype(float), r.permutation(400)
    lists = grid.Lists(np.arange(9), 3)
    for at in range(0, 400, 40):
        for of in (slice(0, 4), slice(4, 9)):
            lists.add(where[at : at + 40], score[of, at : at + 40], of)
    for i in range(9):
        order = np.lexsort((where, -score[i]))[:3]
        assert lists.where[i].tolist() == where[order].tolist() and lists.score[i].tolist() == score[i][order].tolist()


def test_blocks_are_sent_as_often_whatever_the_partitions(spark, monkeypatch):
    """A larger input has more partitions; the copies of a block follow the cores."""
    import re

    monkeypatch.setattr(grid.cells, "__defaults__", (600, 1500, 0))
    queries, index, scores = tables(spark, 60, 150)
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        found = search.above_cuts(queries, index, 20.0, block_bytes=600)
        copies = re.findall(r"explode\(sequence\(cast\(0 as bigint\), cast\((\d+) as bigint\)", found._jdf.queryExecution().analyzed().toString())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert copies == ["2", "2"] and found.count() == (scores > 20).sum()


def test_numbers_that_single_precision_holds_are_sent_so(spark):
    r = np.random.default_rng(4)
    for x, narrow in ((r.normal(size=(50, 64)).astype(np.float32).astype(float), True), (r.normal(size=(50, 64)), False), (np.full((3, 2), 1e300), False), (np.full((3, 2), np.nan), False)):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "col_id long, vec array<double>").coalesce(1)
        packed = grid.packed(rows, 1 << 20).first()
        table = grid.unpacked(bytes(packed["rows"]))
        assert (packed["size"] < 64 * 50 * 6) == (narrow or x.size < 100) and (str(table.schema.field("vec").type.value_type) == "float") == narrow
        np.testing.assert_array_equal(grid.matrix(table.column("vec")), x)


@pytest.mark.parametrize("kind", ["real", "complex", "abs"])
def test_what_single_precision_leaves_open_is_settled_in_double(kind, monkeypatch):
    """Scores that differ by 1e-10, vectors of unlike lengths, numbers too large for single precision and none at all."""
    r = np.random.default_rng(5)
    q, base = r.normal(size=(2 * search.TILE_QUERIES + 3, 16)), r.normal(size=(7, 16))
    near = base[r.integers(0, 7, 700)] * (1 + 1e-10 * r.integers(0, 50, (700, 1)))
    none = near.copy()
    none[5, 3] = np.nan
    monkeypatch.setattr(search, "OPEN", 1)
    for x in (near, near * 10.0 ** r.integers(-6, 7, (700, 1)), near * 1e30, none):
        want = np.concatenate([s for _, s in search._scores(q, x, kind)])
        # Where the scores are large, 12 decimals are beyond double precision: one sum is compared with itself.
        exact = lambda a, b, i, c, kind: np.concatenate([s for _, s in search._scores(a, b, kind)])[i, c]
        monkeypatch.setattr(search, "_scores_of", exact)
        rows, held = search.Vectors(q), search.Vectors(x)
        order = np.lexsort((np.broadcast_to(np.arange(700), want.shape), -np.where(np.isnan(want), -np.inf, want)), axis=1)[:, :4]
        lists = grid.Lists(np.arange(len(q)), 4)
        least = np.full(700, np.nan)
        for at in range(0, 700, 100):
            part = held.part(slice(at, at + 100))
            search._into_lists(lists, rows, np.arange(at, at + 100), part, kind)
            least[at : at + 100] = search._least(rows, part, least[at : at + 100], kind)
        np.testing.assert_allclose(lists.score, np.take_along_axis(want, order, 1), rtol=1e-13, atol=2e-12)
        np.testing.assert_allclose(least, np.fmin.reduce(want, axis=0), rtol=1e-13, atol=2e-12)
        cut = np.full(700, np.nanmedian(want))
        hits = sum(len(i) for i, _, _ in search._above(rows, held, cut, kind))
        assert hits == (want > cut).sum()


def test_scores_of_single_pairs_are_those_of_the_product():
    r = np.random.default_rng(6)
    q, x = r.normal(size=(40, 8)), r.normal(size=(3000, 8))
    i, c = np.divmod(np.arange(120_000), 3000)
    for kind in ("real", "complex", "abs"):
        np.testing.assert_allclose(search._scores_of(q, x, i, c, kind), np.concatenate([s for _, s in search._scores(q, x, kind)])[i, c], atol=2e-12)


@pytest.mark.parametrize("kind", ["real", "complex"])
@pytest.mark.parametrize("scale", [1e-8, 1.0, 1e6])
def test_single_precision_is_off_by_its_bound_at_most(kind, scale):
    r = np.random.default_rng(7)
    for d in (2, 64, 512):
        q, x = search.Vectors(scale * r.normal(size=(30, d))), search.Vectors(r.uniform(0, 1, size=(300, d)))
        rough, off = search._rough(q, x, kind)
        exact = q.exact @ x.exact.T
        if kind == "complex":
            exact = exact**2 + (q.exact @ np.concatenate((x.exact[:, d // 2 :], -x.exact[:, : d // 2]), 1).T) ** 2
        assert (np.abs(rough - exact) <= off[:, None]).all()


@pytest.mark.parametrize("broadcast", [0, grid.BROADCAST])
def test_a_task_is_given_few_cells_at_once(spark, broadcast):
    """64 cells of about 260 KB: a task's memory does not grow with their number."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    vec = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3) + i)
    queries = spark.range(0, 2048, 1, 1).select(F.col("id").alias("query_id"), vec.alias("vec"))
    index = spark.range(0, 2048, 1, 1).select(F.col("id").alias("col_id"), vec.alias("vec"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    seen = grid.cells(queries, index, 1 << 17, 1 << 17, broadcast).coalesce(1).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in seen) >= 64 and max(r["size"] for r in seen) <= 5 << 20


@pytest.mark.parametrize("broadcast", [0, grid.BROADCAST])
def test_pairs_above_cuts_come_by_query_and_block(spark, monkeypatch, broadcast):
    """A query's pairs with a block of the index are one stretch, by column: they were one for each tile. Cuts that are an expression meet no join."""
    monkeypatch.setattr(grid.cells, "__defaults__", (600, 1500, broadcast))
    monkeypatch.setattr(search, "TILE", 16)
    queries, index, scores = tables(spark, 60, 150, parts=1)
    queries, index = queries.coalesce(1), index.orderBy("col_id").withColumn("label", F.when(F.col("col_id") % 5 > 0, F.col("col_id") % 5))
    found = search.above_cuts(queries, index, 2.0 * F.col("label"))
    cut = np.where(np.arange(150) % 5 > 0, 2.0 * (np.arange(150) % 5), np.inf)
    want = sorted((int(q), int(c), float(scores[q, c])) for q, c in zip(*np.nonzero(scores > cut)))
    rows = [(r["query_id"], r["col_id"], r["score"], r["part"]) for r in found.withColumn("part", F.spark_partition_id()).collect()]
    assert sorted(r[:3] for r in rows) == want
    stretches = sum(a[0] != b[0] or a[3] != b[3] for a, b in zip(rows, rows[1:])) + 1
    assert stretches <= 60 and all(a[1] < b[1] for a, b in zip(rows, rows[1:]) if a[0] == b[0])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
