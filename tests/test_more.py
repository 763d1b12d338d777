"""Two-phase search, calibration, the server, streams that fail, fetches and formats against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake import __main__ as cli
from strandlake import queries, queries_more
from strandlake.functions import dna, quant
from strandlake.operators import encode, sampling, scoring, search, windows
from strandlake.plans import mapping
from strandlake.server import Server
from strandlake.sources import fasta, tables
from strandlake.streaming import reads as streams

ROPE = encode.Rope(k=60, s=4, m=1, c=4)


def genome(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(0, ">a first", genome(1, 1500)), (3, ">b", genome(2, 700)), (7, ">c", "ACGT")], "rec_id long, head string, seq string")


def test_two_phase_search_finds_every_offset(spark, records):
    """The best offset on either strand, against every offset of every record."""
    seqs = {0: genome(1, 1500), 3: genome(2, 700)}
    r = random.Random(5)
    rows = []
    for i in range(20):
        rec = r.choice([0, 3])
        at = r.randrange(len(seqs[rec]) - 60)
        frag = seqs[rec][at : at + 60]
        rows.append((i, frag if i % 2 else reverse(frag)))
    reads = spark.createDataFrame(rows, "read_id long, frag string")
    frags = mapping.index_windows(records, 60, 10)
    got = {x.read_id: x for x in search.two_phase(reads, records, frags, ROPE, 0.25, 11, 12).collect()}
    encoder = encode.Encoder(ROPE)
    assert len(got) == 20
    for i, frag in rows:
        best = max((search.sliding(encoder, f, seqs[rec])[::-1] + (-rec, -strand) for rec in seqs for strand, f in ((0, frag), (1, reverse(frag)))))
        found = got[i]
        assert found.score == pytest.approx(best[0], rel=1e-6) and (found.rec_id, found.strand, found.start) == (-best[2], -best[3], best[1] + 1)


def test_mapping_without_an_index_is_mapping_with_one(spark, records):
    reads = sampling.sample_reads(records, 30, 60, 0.05, 2, nfree=False)
    a = mapping.map_onto(reads, records, ROPE, 10, 5).select("read_id", "rank", "col_id", "start", "strand", "src")
    b = mapping.map_reads(reads, mapping.build_index(records, ROPE, 10), ROPE, 5, precision="f32")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    small = search.top_k_of_windows(mapping.encode_reads(reads, ROPE), mapping.index_windows(records, 60, 10), ROPE, 5, block_bytes=1)
    assert small.count() == 150
    with pytest.raises(Exception, match="no bits"):
        mapping.index_windows(records.withColumn("rec_id", F.lit(1 << 31)), 60, 10).collect()


def test_calibrated_cuts_against_a_plain_version(spark, records):
    frags = windows.windows(records, 60, 60).select((F.col("rec_id") * 10_000 + F.col("start")).alias("col_id"), "frag")
    got = {x.col_id: x.cut for x in search.calibrated_cuts(frags, ROPE, 4, 0.1, 9).collect()}
    encoder = encode.Encoder(ROPE)
    for x in frags.collect():
        code, best = np.array(["ACGT".index(c) for c in x.frag], np.uint8), np.inf
        z = encoder([x.frag])[0][0]
        for n in range(4):
            changed = sampling.mutate(code, 0.1, np.random.default_rng([9, x.col_id, n]))
            w = encoder(["".join("ACGT"[c] for c in changed)])[0][0]
            half = len(w) // 2
            best = min(best, (z @ w) ** 2 + (z[:half] @ w[half:] - z[half:] @ w[:half]) ** 2)
        assert got[x.col_id] == pytest.approx(best, abs=1e-9)
    assert {round(x.cut, 9) for x in search.calibrated_cuts(frags, ROPE, 2, 0.0).collect()} == {1.0}


def test_server_runs_a_changed_file_again(spark, tmp_path):
    path, ran = tmp_path / "commands", []

    def run(words):
        ran.append(words)
        if words[0] == "bad":
            raise ValueError("no such command")

    server = Server(spark, str(path), run)
    path.write_text("# a remark\nindex 'a b' --k 5\n\nbad\nmap x\n")
    first = server.step()
    assert ran == [["index", "a b", "--k", "5"], ["bad"], ["map", "x"]] and [type(e) for e in first] == [type(None), ValueError, type(None)]
    assert server.step() == []
    path.write_text("map y\n")
    said = []
    server.serve(0.01, 2, said.append)
    assert ran[-1] == ["map", "y"] and said == [None]


def test_first_error_stops_the_other_streams(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def bad(rows, n):
        raise ValueError("broken sink")

    def start(name, sink, again):
        rows = streams.read_stream(spark, str(tmp_path / "in"), "id long")
        writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / name))
        return (writer.trigger(processingTime="100 milliseconds") if again else writer.trigger(availableNow=True)).start()

    good = start("good", lambda rows, n: None, True)
    with pytest.raises(Exception, match="broken sink"):
        streams.first_error([good, start("bad", bad, False)])
    assert not good.isActive
    streams.first_error([start("once", lambda rows, n: None, False)])


def test_numbering_of_records_over_many_partitions(spark, tmp_path):
    rows = [(i, genome(i, 5 + i % 40)) for i in range(200)]
    for part in range(4):
        text = "junk before\n" * (part % 2) + "".join(f">r{i} x\r\n{s[:9]}\n{s[9:]}\n" for i, s in rows[part * 50 : part * 50 + 50])
        (tmp_path / f"p{part}.fasta").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    try:
        found = fasta.read_fasta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.rec_id for r in found) == list(range(200))
    assert {r.name: r.seq for r in found} == {f"r{i}": s for i, s in rows}


def test_runs_count_places_in_characters(spark):
    text = "éNN😀nA\nNN"
    got = windows.n_runs(spark.createDataFrame([("x", text), ("y", ""), ("z", None)], "rec_id string, seq string")).collect()
    assert sorted((r.start, r.length) for r in got) == [(2, 2), (5, 1), (8, 2)]


def test_fetch_across_blocks(spark):
    seq = genome(4, 1000)
    recs = spark.createDataFrame([(1, seq), (2, "")], "rec_id long, seq string")
    places = [(1, a, k) for a in (1, 63, 64, 65, 990, 1000, 1001) for k in (1, 64, 200)] + [(2, 1, 5), (9, 1, 5), (1, 1, 1)]
    got = fasta.fetch(fasta.blocks(recs, 64), spark.createDataFrame(places, "rec_id long, start long, k long"), 64).collect()
    assert sorted(map(tuple, got)) == sorted((r, a, k, seq[a - 1 : a - 1 + k] if r == 1 else "") for r, a, k in places)


def test_consensus_counts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(scoring, "GATHERED", 2000)
    monkeypatch.setattr(scoring, "COLUMNS", 7)
    r = random.Random(8)
    rows = [(g, "".join(r.choice("ACGTN-acg") for _ in range(r.randrange(0, 40)))) for g in "xyz" for _ in range(30)] + [("w", "NN--"), ("v", "")]
    got = {x.g: x.consensus for x in scoring.consensus(spark.createDataFrame(rows, "g string, seq string"), "g").collect()}
    for g in "xyzw":
        held = [s.upper() for h, s in rows if h == g]
        want = ""
        for i in range(max(map(len, held))):
            votes = {c: sum(len(s) > i and s[i] == c for s in held) for c in "ACGT"}
            best = max(sorted(votes), key=lambda c: votes[c])
            want += best if votes[best] else "G"
        assert got[g] == want


def test_quantiles_against_numpy(spark):
    r = random.Random(9)
    for values in ([1.0], [2.0, 2.0, 2.0], [r.gauss(0, 1) for _ in range(501)], [float(r.randrange(5)) for _ in range(400)] + [1e9]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for x in scoring.quantiles(rows, "v", (0.0, 0.1, 0.5, 0.99, 1.0)).collect():
            assert x.value == pytest.approx(np.quantile(values, x.share))
    assert [x.value for x in scoring.quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)).collect()] == [None]


def test_saved_values_and_halves(spark, tmp_path):
    tables.save({"a": [1, None, "é"]}, str(tmp_path / "value"), spark)
    assert tables.load(spark, str(tmp_path / "value")) == {"a": [1, None, "é"]}
    index = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "col_id long, vec array<double>")
    tables.write_split_index(index, str(tmp_path / "split"), k=2)
    (row,) = tables.read_split_index(spark, str(tmp_path / "split"), k=2)[0].collect()
    assert row.vec == [1.0, 2.0, 3.0, 4.0] and row.turned == [3.0, 4.0, -1.0, -2.0]
    with pytest.raises(ValueError):
        tables.read_split_index(spark, str(tmp_path / "split"), k=3)
    wide = index.select(quant.stacked("vec", F.array(F.lit(5.0), F.lit(6.0))).alias("v")).first()["v"]
    assert wide == [1.0, 2.0, 5.0, 3.0, 4.0, 6.0]


def test_colon_headers_need_a_length(spark):
    truth = spark.createDataFrame([(1, 50), (2, None)], "read_id long, len long")
    assert scoring.without_lengths(truth.filter("read_id = 1"), 50).collect()[0].len == 50
    with pytest.raises(Exception, match="no length"):
        scoring.without_lengths(truth, 50).collect()


def test_loose_provenance(spark):
    heads = [">r1 start=5 src=chr1 len=7 id=x9", ">r2 src=chr2", ">chr3:11:true#2", ">chr3:x:true", ">plain", "", ">a:b start=3"]
    got = [x.p for x in spark.createDataFrame([(h,) for h in heads], "h string").select(dna.loose_provenance("h").alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [("x9", "chr1", 5, 7), ("r2", "chr2", 0, 0), ("chr3:11:true#2", "chr3", 12, 0), None, None, None, ("a:b", "", 3, 0)]


def test_commands_generate_and_mutate(spark, tmp_path, capsys):
    run = lambda *words: cli.run(spark, cli.parser().parse_args(list(map(str, words))))
    run("random", tmp_path / "ref.fasta", "--n", 2, "--length", 400)
    run("reads", tmp_path / "ref.fasta", tmp_path / "reads.fasta", "--n", 20, "--k", 50, "--err", 0.1)
    assert fasta.read_fasta(spark, str(tmp_path / "reads.fasta")).filter("nchar = 50").count() == 20
    run("mutate", tmp_path / "ref.fasta", tmp_path / "mutated.fasta", "--err", 0.1)
    assert fasta.read_fasta(spark, str(tmp_path / "mutated.fasta")).filter("nchar = 400").count() == 2
    run("sample", tmp_path / "ref.fasta", tmp_path / "sample.fasta", "--n", 5, "--k", 50)
    run("sample", tmp_path / "ref.fasta", tmp_path / "sample.fasta", "--n", 9, "--k", 50)
    assert "is there already" in capsys.readouterr().out and fasta.read_fasta(spark, str(tmp_path / "sample.fasta")).count() == 5
    run("evaluate", tmp_path / "ref.fasta", "--n", 10, "--k", 50, "--kstep", 5, "--err", 0.0, "--s", 4, "--c", 4)
    assert "RESULT ref=" in (said := capsys.readouterr().out) and "reads=10" in said and "top_pct=100.000" in said


def written(spark, folder, texts):
    """A folder of the driver's with these documents."""
    rows = [(i, f"src{i % 3}", "en", text, len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def same_as_sql(spark, name, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    return sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["n3_encoding", "k9_encoding_file", "n4_big_endian_encoding", "n9_streamed_encoding", "a25_norms"])
def test_windows_without_any_bin_have_no_row(spark, tmp_path, name):
    """AGAGA and GAGAG both fold into the slot that is cleared."""
    folder = written(spark, tmp_path, ["a " * 350, genome(4, 450), "ag" * 100 + genome(5, 210), None, "", "ACG", "?" * 410])
    assert same_as_sql(spark, name, folder)


def test_a_window_whose_bins_cancel_out_is_its_own_best(spark, tmp_path):
    """25 turns of one letter in eight: the sums are what rounding leaves of them."""
    assert same_as_sql(spark, "a20_calibrated_cuts", written(spark, tmp_path, ["osjaque " * 60, "?" * 410, genome(6, 450), None]))


def test_grams_of_pairs_are_counted_in_place_and_by_join_alike(spark, monkeypatch):
    """Repeated numbers, nulls, short texts, characters of any plane, grams across the texts' border; long pairs go by the join."""
    r = random.Random(3)
    letters = ["ab", "ab\U0001f600é", "abcdefgh"]
    rows = [(i // 2 if i < 20 else i, *("".join(r.choice(letters[i % 3]) for _ in range(r.choice([0, 3, 15, 16, 17, 60, 200]))) for _ in "ab")) for i in range(120)]
    rows += [(900, None, "a" * 20), (901, "a" * 20, None), (902, "x" * 15, "x" * 40), (903, "y" * 16, "y" * 40)]
    for n in (1, 5, 16):
        grams = lambda t: [(t or "")[i : i + n] for i in range(len(t or "") - n + 1)]
        known = {}
        for i, a, _ in rows:
            known.setdefault(i, set()).update(grams(a))
        total = {i: sum(g in known[i] for j, _, b in rows if j == i for g in grams(b)) for i in known}
        want = sorted((i, total[i]) for i, _, _ in rows)
        for most in (1 << 20, 50, 0):
            monkeypatch.setattr(scoring, "LONG", most)
            got = scoring.shared_gram_counts(spark.createDataFrame(rows, "pair_id long, a string, b string"), n)
            assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("kind", ["real", "complex"])
def test_cuts_of_windows_are_cuts_of_an_index(spark, records, kind):
    """No vector of the windows leaves its task; the pairs and scores are those of an encoded index."""
    reads = mapping.encode_reads(sampling.sample_reads(records, 30, 60, 0.05, 2, nfree=False), ROPE, "f64")
    frags = mapping.index_windows(records, 60, 10)
    index = encode.encode(frags.select("col_id", "frag"), ROPE, "f64")
    for cuts in (0.3, frags.select("col_id", (0.2 + 0.1 * F.col("strand")).alias("cut"))):
        a, b = search.above_cuts_of_windows(reads, frags, cuts, ROPE, kind, 1), search.above_cuts(reads, index, cuts, kind)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []


def test_full_lists_take_only_what_reaches_their_last():
    """Against sorting everything; ties go to smaller columns, NaN takes no part, and no partition of the whole tile is made."""
    from unittest import mock

    from strandlake.operators import grid

    r = np.random.default_rng(2)
    lists, held = grid.Lists(np.arange(6), 3), np.zeros((6, 0))
    for n in range(6):
        score = np.round(r.random((6, 400)), 2 if n else 1)
        score[r.random(score.shape) < 0.05] = np.nan
        with mock.patch.object(np, "partition", wraps=np.partition) as cut:
            lists.add(np.arange(400) + 400 * n, score)
        assert all(c.args[0].shape[1] < 400 for c in cut.call_args_list) or n == 0
        held = np.concatenate((held, score), 1)
        whole = np.where(np.isnan(held), -np.inf, held)
        order = np.lexsort((np.broadcast_to(np.arange(whole.shape[1]), whole.shape), -whole), axis=1)[:, :3]
        assert (lists.where == order).all() and (lists.score == np.take_along_axis(whole, order, 1)).all()


def test_most_queries_have_sql():
    assert {n for n in queries.QUERIES if n not in queries.SQL} == {"c1_map_sampled_reads", "r1_refined_places", "w10_random_sample", "a24_sample_check", "g7_mutation_sweep", "a21_cutting_threshold"}
    assert len(queries_more.SQL) > 120


def test_consensus_of_a_group_in_all_partitions(spark, monkeypatch):
    """Rows of counts stay as small as a block's, in both levels, whatever the number of tasks and the gathered bytes."""
    monkeypatch.setattr(scoring, "COLUMNS", 8)
    monkeypatch.setattr(scoring, "GATHERED", 3000)
    rows = [("a" if i % 3 else None, "ACGT" * (5 + i % 4) + "acgtN-"[: i % 6]) for i in range(90)] + [("b", ""), ("b", None), ("c", "NNN--")]
    got = {r["g"]: (r["n"], r["consensus"]) for r in scoring.consensus(spark.createDataFrame(rows, "g string, seq string").repartition(40), "g").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        texts = [(t or "").upper() for h, t in rows if h == g]
        columns = ([t[i] for t in texts if i < len(t) and t[i].isalpha() and t[i] != "N"] for i in range(max(map(len, texts))))
        want[g] = (len(texts), "".join(min(c, key=lambda x: (-c.count(x), x)) if c else "G" for c in map(list, columns)) or None)
    assert got == want


def test_streamed_mapping_writes_no_index(spark, monkeypatch):
    """The vectors of all windows are many times the records: reads that arrive meet windows that are encoded there."""
    from strandlake import queries_more
    from strandlake.sources import tables

    def refused(*_, **__):
        raise AssertionError("an index was written")

    monkeypatch.setattr(tables, "write_index", refused)
    assert queries_more.t5_streamed_top_k(spark, "/root/testdata/sf0.001").first().asDict() == {"reads": 500, "again": 500}


def test_rows_of_counts_are_small():
    counts = np.zeros((scoring.COLUMNS, scoring._LETTERS), np.int32)
    counts[:300, [0, 2, 6, 19]] = np.random.default_rng(0).integers(0, 1000, (300, 4))
    held = scoring._squeezed(counts.ravel())
    assert (scoring._widened(held) == counts.ravel()).all() and len(held) * 20 < 8 * counts.size


def test_stretches_leave_a_task_some_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(windows, "GATHERED", 100)
    member = np.zeros(256, bool)
    member[list(b"AC")] = True
    texts = ["AN" * 60, None, "", "ACéC", "NC" * 60, "A"]
    found = list(windows._stretches(iter([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["rec_id", "seq"])]), member))
    assert [b.num_rows for b in found] == [122, 1]
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    want = [(0, 2 * i + 1, 1) for i in range(60)] + [(3, 1, 2), (3, 4, 1)] + [(4, 2 * i + 2, 1) for i in range(60)] + [(5, 1, 1)]
    assert rows == want and len(found) > 1


def test_hash_of_a_text_is_that_of_its_codes(spark):
    r = random.Random(4)
    texts = [None] + ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 3, 8, 19, 1000)]
    rows = spark.createDataFrame([(t,) for t in texts], "seq string").select(dna.dna_hash_of("seq").alias("a"), dna.dna_hash(dna.codes("seq")).alias("b")).collect()
    assert [x["a"] for x in rows[1:]] == [x["b"] for x in rows[1:]] and rows[0]["a"] is None


def test_a_measure_stands_in_place_of_the_vectors(spark):
    recs = spark.createDataFrame([(i, f">r{i}", "ACGTTGCAGGATCCATTGACA" * 6) for i in range(3)], "rec_id long, head string, seq string")
    rope = encode.Rope(40, 3, 1, 3)
    whole = {x["col_id"]: sum(v * v for v in x["vec"][: rope.dim]) for x in mapping.build_index(recs, rope, 20, "f64").collect()}
    index = mapping.build_index(recs, rope, 20, "f64", measure=lambda v: (v[:, : rope.dim] ** 2).sum(1))
    got = {x["col_id"]: x["measure"] for x in index.collect()}
    assert "vec" not in index.columns and got.keys() == whole.keys() and all(abs(got[c] - whole[c]) < 1e-12 for c in got)


def test_mirrored_windows_are_those_of_the_turned_record(spark, monkeypatch):
    """Blocks that end in the middle of a record and at its end, records shorter than a window, none at all, and letters of more than one byte."""
    monkeypatch.setattr(windows, "BLOCK", 3)
    r = random.Random(5)
    texts = [None, "", "ACGTACG", "ACGTACGT"] + ["".join(r.choice("ACGT") for _ in range(n)) for n in (9, 31, 32, 33, 200)] + ["ACéGT" * 9, "AC\U0001d11eGT" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "rec_id long, seq string")
    turn = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k, kstep in ((8, 8), (8, 3), (5, 11)):
        got = sorted((x["rec_id"], x["start"], x["frag"], x["first"], x["last"], x["there"]) for x in windows.mirrored_windows(rows, k, kstep).collect())
        want = [(i, a + 1, t[a : a + k], len(t) - a - k + 1, len(t) - a, turn(t)[len(t) - a - k : len(t) - a]) for i, t in enumerate(texts) if t for a in range(0, len(t) - k + 1, kstep)]
        assert got == want


def test_mirrored_bounds_of_a_long_record_take_no_time_that_grows_with_its_square(spark, tmp_path):
    """A record was turned once for each of its windows: 2,000 times 300,000 letters."""
    import time

    from strandlake import queries_more

    text = "".join(random.Random(6).choice("ACGTacgtNxyz ") for _ in range(300_000))
    spark.createDataFrame([(0, text, "en", "src0"), (1, None, "en", "src0")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.perf_counter()
    rows = queries_more.w5_mirrored_bounds(spark, str(tmp_path)).collect()
    assert time.perf_counter() - began < 20
    assert sorted(map(tuple, rows)) == [(0, a, 300_000 - a - 148, 300_001 - a, True) for a in range(1, 300_000, 150)]


ODD = [None, "", "ACGTAC", "acgtnNxy GATTACA" * 9, "\u00e9AC\U0001d11eGT" * 40, "G" * 300, "TTTTTTTTTT" * 31]


def test_pieces_hold_the_windows_of_the_cleaned_record(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 3)
    monkeypatch.setattr(windows, "PIECES", 100)
    records = spark.createDataFrame(list(enumerate(ODD)), "rec_id long, seq string")
    for k, kstep in ((20, 20), (20, 7), (7, 15), (60, 5)):
        want = {(x["rec_id"], x["start"], x["frag"]) for x in windows.windows(records.withColumn("seq", dna.acgt("seq")), k, kstep).collect()}
        rows = windows.pieces(records, k, kstep).collect()
        got = [(x["rec_id"], x["start"] + a, bytes(x["text"][a : a + k]).decode()) for x in rows for a in range(0, len(x["text"]) - k + 1, kstep)]
        assert set(got) == want and len(got) == len(want) > 0
        assert all(x["last"] == x["start"] + (len(x["text"]) - k) // kstep * kstep for x in rows)


@pytest.mark.parametrize("rope", [encode.Rope(40, 4, 1, 4), encode.Rope(40, 5, 2, 3, order="big"), encode.Rope(40, 4, 1, 4, normalize=1), encode.Rope(40, 9, 1, 4)])
@pytest.mark.parametrize("kind", ["real", "complex", "abs"])
def test_reads_meet_windows_encoded_there_as_those_of_an_index(spark, monkeypatch, rope, kind):
    """The same windows and the very same scores, for reads of Gs alone too, whichever windows single precision leaves open."""
    monkeypatch.setattr(search, "TILE", 16)
    r = random.Random(9)
    texts = ODD + ["".join(r.choice("ACGT") for _ in range(700)) for _ in range(4)]
    records = spark.createDataFrame([(i, f">r{i}", t) for i, t in enumerate(texts)], "rec_id long, head string, seq string")
    reads = [t[a : a + 40] for t in texts[-4:] for a in (0, 33, 500)] + ["G" * 40, "T" * 40, "GGGGA" * 8]
    reads = spark.createDataFrame([(i, t) for i, t in enumerate(reads)], "read_id long, frag string")
    for kstep in (40, 9):
        got = mapping.map_onto(reads, records, rope, kstep, 3, kind).select("read_id", "rank", "col_id", "score", "start", "strand", "record").collect()
        frags = mapping.index_windows(records, 40, kstep)
        want = search.top_k_of_windows(mapping.encode_reads(reads, rope), frags, rope, 3, kind).join(frags.select("col_id", "start", "strand", F.col("head").alias("record")), "col_id")
        assert len(got) == 45 and sorted(map(tuple, got)) == sorted(tuple(x) for x in want.select("query_id", "rank", "col_id", "score", "start", "strand", "record").collect())


def test_records_without_bits_are_an_error_of_pieces_too(spark):
    reads = spark.createDataFrame([(0, "ACGT" * 10)], "read_id long, frag string")
    records = spark.createDataFrame([(1 << 31, ">a", "ACGT" * 50)], "rec_id long, head string, seq string")
    with pytest.raises(Exception, match="no bits"):
        mapping.map_onto(reads, records, encode.Rope(40, 4, 1, 4), 40).collect()


def test_only_open_windows_are_encoded_exactly_and_reads_of_gs_open_none(monkeypatch):
    """Three reads of Gs in 250 tie with every window: each tile was computed in double precision as a whole."""
    rope, r = encode.Rope(200, 4, 1, 4), np.random.default_rng(3)
    texts = ["".join(t) for t in r.choice(list("ACGT"), (4096, 200))]
    reads = [t[60:] + "A" * 60 for t in texts[::17]] + ["G" * 200] * 3
    queries = search.Vectors(encode.Encoder(rope)(reads)[0])
    tiles = search._piece_tiles(rope, 200, "f32")(pa.table({"col_id": pa.array(np.arange(64) * 1000, pa.int64()), "text": pa.array(["".join(texts[i : i + 64]).encode() for i in range(0, 4096, 64)], pa.binary())}))
    plain, lists, whole, exact = search.grid.Lists(np.arange(len(reads)), 2), search.grid.Lists(np.arange(len(reads)), 2), [], []
    for col, x in tiles:
        for of, score in search._scores(queries.exact, search.quantize(x.exact, "f32"), "real"):
            plain.add(col, score, of)
        x.whole = None
    scores, rows = search._scores, search.Windows.rows
    monkeypatch.setattr(search, "_scores", lambda *a: whole.append(1) or scores(*a))
    monkeypatch.setattr(search.Windows, "rows", lambda self, which: exact.append(len(which)) or rows(self, which))
    for col, x in tiles:
        search._into_lists(lists, queries, col, x, "real")
    assert (lists.score == plain.score).all() and (lists.where == plain.where).all()
    assert len(tiles) == 8 and len(whole) == 1 and sum(exact) < 2 * search.TILE


def test_reads_of_the_stream_are_those_of_the_cleaned_records(spark):
    d = "/root/testdata/sf0.001"
    a = sampling.sample_reads(queries.clean(spark, d), 500, 200)
    b = sampling.sample_reads(queries.records(spark, d), 500, 200, nfree=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
