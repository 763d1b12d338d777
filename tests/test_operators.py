import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import encode, sampling, scoring, search, windows
from strandlake.plans import mapping

CODE = {"A": 0, "C": 1, "G": 2, "T": 3}


def rand_dna(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def records(spark, seqs):
    return spark.createDataFrame([(i, f">rec{i} text", s) for i, s in enumerate(seqs)], "rec_id long, head string, seq string")


def plain_rope(seq, rope):
    """The definition, one s-mer at a time."""
    h = np.zeros((4**rope.c, rope.m), complex)
    turns = [1.0] if rope.m == 1 and rope.frequencies == "spread" else ([2 * i / (rope.m - 1) + 1 for i in range(rope.m)] if rope.frequencies == "spread" else list(range(1, rope.m + 1)))
    for p in range(len(seq) - rope.s + 1):
        word = seq[p : p + rope.s]
        digits = word if rope.order == "big" else word[::-1]
        number = 0
        for ch in digits:
            number = number * 4 + CODE[ch]
        mask = 4**rope.c - 1
        slot = ((number & mask) ^ (((number >> (2 * rope.c)) * 2654435761) % 2**32 & mask)) if rope.scramble else number
        for i, t in enumerate(turns):
            h[slot, i] += np.exp(1j * t * 2 * math.pi / rope.k * p) if rope.phase else 1
    if rope.zero_g:
        h[2 * sum(4**i for i in range(rope.c))] = 0
    guard = {0: 1e-16, 1: 1e-7, 2: 2**-52, 3: 2**-52}.get(rope.normalize, 0)
    if rope.normalize == 2:
        h = h / (abs(h) + guard)
    if rope.normalize == 3:
        h = h / np.sqrt(abs(h) + guard)
    if rope.normalize == 0:
        h = h / (math.sqrt((abs(h) ** 2).sum()) + guard)
    elif rope.normalize > 0:
        h = h / (np.sqrt((abs(h) ** 2).sum(0)) + guard)
    flat = h.reshape(-1)
    return np.concatenate((flat.real, flat.imag))


VARIANTS = [encode.Rope(32, 3, 1, 3), encode.Rope(40, 4, 2, 3), *(encode.Rope(40, 4, 3, 2, normalize=n) for n in (1, 2, 3)), encode.Rope(30, 4, 2, 4, order="big"), encode.Rope(30, 3, 1, 3, scramble=False, zero_g=False, frequencies="whole"), encode.Rope(30, 3, 2, 3, scramble=False, phase=False, zero_g=False, normalize=1)]


@pytest.mark.parametrize("rope", VARIANTS)
def test_encoder_against_definition(spark, rope):
    seqs = [rand_dna(i, rope.k) for i in range(6)] + ["G" * rope.k, "AC" * (rope.k // 2)]
    frags = spark.createDataFrame(list(enumerate(seqs)), "id long, frag string")
    got = {r.id: np.array(r.vec) for r in encode.encode(frags, rope, "f64").collect()}
    for i, s in enumerate(seqs):
        assert np.allclose(got[i], plain_rope(s, rope), atol=1e-9)
    long = encode.normalize_long(encode.encode_long(frags, rope), rope).collect()
    dense = {i: np.zeros(2 * rope.dim) for i in range(len(seqs))}
    for r in long:
        dense[r.id][r.bin], dense[r.id][rope.dim + r.bin] = r.re, r.im
    for i in dense:
        assert np.allclose(dense[i], got[i], atol=1e-6)


def test_encoder_rejects_nonsense():
    for bad in (dict(k=10, s=17), dict(k=3, s=5), dict(k=10, s=3, c=4), dict(k=10, s=3, c=0)):
        with pytest.raises(ValueError):
            encode.Rope(**{"c": 3, **bad})


def test_windows_edges(spark):
    seqs = ["", "A" * 49, "A" * 50, rand_dna(1, 51), rand_dna(2, 157)]
    got = windows.windows(records(spark, seqs), 50, 20).collect()
    want = {(i, s + 1, q[s : s + 50]) for i, q in enumerate(seqs) for s in range(0, len(q) - 49, 20)}
    assert {(r.rec_id, r.start, r.frag) for r in got} == want and len(got) == len(want)
    c = windows.window_counts(records(spark, seqs), 50, 20).first()
    assert (c.n_windows, c.n_records, c.n_kept) == (len(want), 5, 3)
    both = windows.both_strands(windows.fragments(records(spark, [rand_dna(3, 120)]), 50)).collect()
    assert len(both) == 4 and {r.strand for r in both} == {0, 1}


def brute_runs(seq, letters):
    out, start = [], None
    for i, c in enumerate(seq + "\0"):
        if c in letters and start is None:
            start = i
        if c not in letters and start is not None:
            out.append((start + 1, i - start))
            start = None
    return out


def test_runs_and_pools(spark):
    seqs = ["ACGTNNNacgtnRA", "", "N", "A" * 30 + "N" + "C" * 12 + "x" + "G" * 5, "NNANN"]
    recs = records(spark, seqs)
    assert sorted(map(tuple, windows.n_runs(recs).collect())) == sorted((i, *x) for i, s in enumerate(seqs) for x in brute_runs(s, "Nn"))
    k = 6
    clean = [(i, p + 1) for i, s in enumerate(seqs) for p in range(len(s) - k + 1) if all(c in "ACGTacgt" for c in s[p : p + k])]
    pool = windows.pool(recs, k)
    ranks = pool.groupBy("rec_id").agg(F.sum("n").alias("w")).select("rec_id", F.explode(F.sequence(F.lit(1).cast("long"), "w")).alias("rank"))
    placed = sorted((r.rec_id, r.rank, r.start) for r in sampling.ranks_to_starts(ranks, pool).collect())
    assert [(i, s) for i, _, s in placed] == clean
    total = [r for r in windows.pool_geometry(recs, k).collect() if r.rec_id is None][0]
    assert total.clean == len(clean) and total.raw == sum(max(0, len(s) - k + 1) for s in seqs)
    stats = {r.rec_id: r for r in windows.record_stats(recs).collect()}
    assert (stats[0].n, stats[0].other, stats[0].runs, stats[0].longest, stats[1].percent) == (4, 1, 2, 3, 0.0)


def test_even_sampling(spark):
    seqs = [rand_dna(1, 500), rand_dna(2, 60), rand_dna(3, 49), rand_dna(4, 51)]
    k, n = 50, 40
    sizes = {i: max(0, len(s) - k + 1) for i, s in enumerate(seqs)}
    total = sum(sizes.values())
    quota = {i: n * w / total for i, w in sizes.items()}
    alloc = {i: int(q) for i, q in quota.items()}
    for i in sorted(quota, key=lambda i: (-(quota[i] - alloc[i]), i))[: n - sum(alloc.values())]:
        alloc[i] += 1
    want, number = [], 0
    for i, m in alloc.items():
        for t in range(1, m + 1):
            number += 1
            start = 1 + (2 * t - 1) * sizes[i] // (2 * m) if m <= sizes[i] else (t - 1) % sizes[i] + 1
            want.append((number, f">read_{number} start={start} len={k} src=rec{i}", seqs[i][start - 1 : start - 1 + k]))
    got = sampling.sample_reads(records(spark, seqs), n, k)
    assert sorted((r.read_id, r.head, r.frag) for r in got.collect()) == want


def test_random_sampling_is_fixed_and_inside(spark):
    seqs = [rand_dna(1, 300), "N" * 200, rand_dna(2, 80)]
    a = sampling.sample_reads(records(spark, seqs), 500, 50, seed=3, draw="random").collect()
    b = sampling.sample_reads(records(spark, seqs), 500, 50, seed=3, draw="random").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 500
    assert all(seqs[r.rec_id][r.start - 1 : r.start + 49] == r.frag for r in a) and {r.rec_id for r in a} == {0, 2}
    share = sum(r.rec_id == 0 for r in a) / 500
    assert abs(share - 251 / 282) < 0.06


def test_mutation_contract(spark):
    rng = np.random.default_rng(1)
    code = rng.integers(0, 4, 1000).astype(np.uint8)
    for err in (0.0, 0.01, 0.1, 0.3):
        out = sampling.mutate(code, err, np.random.default_rng(5))
        assert len(out) == 1000 and out.max(initial=0) <= 3
        assert (out == sampling.mutate(code, err, np.random.default_rng(5))).all()
        if not err:
            assert (out == code).all()
    shifted = sampling.mutate_shift(code, 0.1, rng)
    assert len(shifted) == 1000 and (shifted[:950] == code[50:]).all()
    seqs = [rand_dna(i, 200) for i in range(20)]
    check = sampling.verify_sample(sampling.sample_reads(records(spark, seqs), 200, 100, err=0.1, seed=9), records(spark, seqs), 100, 0.1).first()
    assert check.reads == 200 and (check.wrong_length, check.bad_letters, check.unreadable, check.outside) == (0, 0, 0, 0) and check.implausible <= 4


def vectors(spark, n, d, seed, name):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(3)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("kind", ["real", "complex"])
def test_top_k_and_cuts(spark, kind):
    q, qd = vectors(spark, 23, 8, 1, "query_id")
    x, xd = vectors(spark, 300, 8, 2, "col_id")
    x[7] = x[3]
    xd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "col_id long, vec array<double>")
    score = q @ x.T
    if kind == "complex":
        score = score**2 + (q @ np.c_[x[:, 4:], -x[:, :4]].T) ** 2
    score = score.round(12)
    for bytes_ in (64, 1 << 20):
        got = search.top_k(qd, xd, 5, kind, block_bytes=bytes_).orderBy("query_id", "rank").collect()
        want = [(i, r + 1, int(c)) for i in range(23) for r, c in enumerate(np.lexsort((np.arange(300), -score[i]))[:5])]
        assert [(r.query_id, r.rank, r.col_id) for r in got] == want
    cut = np.quantile(score, 0.97)
    assert {(r.query_id, r.col_id) for r in search.above_cuts(qd, xd, float(cut), kind).collect()} == set(map(tuple, np.argwhere(score > cut).tolist()))
    assert sum(r.n for r in search.similarity_histogram(qd, xd, kind).collect()) == 23 * 300
    pairs = {(r.query_id, r.col_id): r.score for r in search.pairs(qd, xd, kind).collect()}
    assert all(abs(pairs[i, j] - score[i, j]) < 1e-9 for i in range(23) for j in range(300))
    with pytest.raises(Exception, match="hits"):
        search.above_cuts(qd, xd, -100.0, kind, most=10).collect()
    assert search.top_k(qd.limit(0), xd, 5).count() == 0


def test_sliding_refinement(spark):
    rope = encode.Rope(60, 4, 2, 3)
    encoder = encode.Encoder(rope)
    area, frag = rand_dna(5, 200), rand_dna(5, 200)[70:130]
    scores = []
    for o in range(141):
        a, b = (encoder.histogram([s])[0] for s in (area[o : o + 60], frag))
        scores.append((np.abs((np.conj(b) * a).sum(0)) ** 2).sum() / (np.abs(b) ** 2).sum())
    assert search.sliding(encoder, frag, area)[0] == 70 == int(np.argmax(scores))
    assert abs(search.sliding(encoder, frag, area)[1] - scores[70]) < 1e-6
    assert search.sliding(encoder, "A" * 60, "A" * 59)[0] == -1
    hits = spark.createDataFrame([(1, 0, 60)], "read_id long, rec_id long, start long")
    reads = spark.createDataFrame([(1, frag)], "read_id long, frag string")
    best = search.refine(hits, reads, records(spark, [area]), rope, 30).first()
    assert (best.read_id, best.rec_id, best.start) == (1, 0, 71)


def test_mapping_end_to_end(spark):
    seqs = [rand_dna(100, 4000), rand_dna(101, 3000)]
    rope = encode.Rope(200, 5, 1, 5)
    for err, least in ((0.0, 60), (0.05, 54)):
        hits, score = mapping.sample_map_score(records(spark, seqs), rope, 20, 60, err=err, k=5)
        s = score.first()
        assert s.total == 60 and s.correct >= least


def test_merge_ranges_example(spark):
    found = [[(1, 10), (1, 15)], [(3, 10), (4, 10)], [(1, 10), (1, 20)]]
    rows = [(i, j, p, x) for i, r in enumerate(found) for j, (p, x) in enumerate(r)]
    got = scoring.merge_ranges(spark.createDataFrame(rows, "read_id long, j long, piece long, loc long"), 6).orderBy("read_id", "part").collect()
    assert [(r.read_id, r.piece, r.first, r.last) for r in got] == [(0, 1, 10, 15), (1, 3, 10, 10), (1, 4, 10, 10), (2, 1, 10, 10), (2, 1, 20, 20)]


def test_paf_and_match_tables(spark):
    rows = [(1, "s:100:true", "-", "s", 150), (2, "s:100:true", "+", "s", 150), (3, "s:9:false", "+", "t", 9), (4, "s:9:false", "+", "s", 30000), (5, "s:9:false", "+", "s", 10), (6, "bad", "+", "s", 1)]
    got = scoring.paf_stats(spark.createDataFrame(rows, "line long, qname string, strand string, tname string, tstart long")).first()
    assert (got.unique, got.top1, got.any) == (3, 1, 2)
    maps = spark.createDataFrame([("a", 1, "r1", 500), ("a", 2, "r1", 95), ("b", 1, "r1", 0), ("c", 1, "r2", 10)], "read string, rank int, record string, pos0 long")
    prov = spark.createDataFrame([("a", "r1", 100, 50), ("c", "r2", 11, 0)], "id string, src string, start long, len long")
    v = scoring.verify_maps(maps, prov, 50).first()
    assert (v.reads, v.skipped, v.top1, v.correct, v.best_mean) == (3, 1, 1, 2, (46 + 50) / 2)


def test_consensus_and_accuracy(spark):
    rows = [("x", "ACG-N"), ("x", "ATGTN"), ("x", "CCGT-"), ("y", "")]
    got = {r.g: r.consensus for r in scoring.consensus(spark.createDataFrame(rows, "g string, seq string"), "g").collect()}
    assert got["x"] == "ACGTG" and got["y"] in (None, "")
    hits = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (2, 1, 7)], "query_id long, rank int, label long")
    queries = spark.createDataFrame([(1, 5), (2, 7), (3, 1)], "query_id long, label long")
    assert [r.found for r in scoring.retrieval_accuracy(hits, queries, 3).orderBy("rank").collect()] == [1, 2, 2]


def test_centroids(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 0.0]), ("b", [0.0, 0.0])], "g string, vec array<double>")
    got = {r.g: r.vec for r in encode.centroids(df, "g").collect()}
    assert np.allclose(got["a"], np.array([4, 2]) / math.sqrt(20)) and got["b"] == [0.0, 0.0]


def test_random_sequences_are_fixed(spark):
    a = sampling.random_sequences(spark, 5, 37, 2).collect()
    assert a == sampling.random_sequences(spark, 5, 37, 2).collect()
    assert all(len(r.seq) == 37 and set(r.seq) <= set("ACGT") for r in a) and len({r.seq for r in a}) == 5
    assert spark.range(1).select(sampling.periodic(F.lit("ACG"), 8)).first()[0] == "ACGACGAC"
    assert spark.range(1).select(dna.edit_rate_plausible(F.lit(5), F.lit(100), F.lit(0.05))).first()[0]


def test_relational_bins_shuffle_sequences_only(spark):
    """What goes through the exchange is the sequences, dealt once by all of their key; letters that are no base count as G."""
    rows = [(i, i % 3, "".join(np.random.default_rng(i).choice(list("ACGTNacgt"), 40))) for i in range(20)]
    frags = spark.createDataFrame(rows + [(99, 0, "ACG"), (98, 0, None)], "a long, b int, frag string")
    for rope in (encode.Rope(40, 4, 2, 3), encode.Rope(40, 4, 1, 4, order="big", scramble=False, zero_g=False)):
        bins = encode.encode_long(frags, rope, ["a", "b"])
        plan = bins.groupBy("a", "b").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        got = np.zeros((20, rope.dim), complex)
        for r in bins.collect():
            got[r.a, r.bin] = complex(r.re, r.im)
        want = encode.Encoder(rope).histogram([t for _, _, t in rows]).reshape(20, -1)
        np.testing.assert_allclose(got, want, atol=1e-12)
