import json
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.operators import encode
from strandlake.plans import mapping
from strandlake.sources import fasta, tables
from strandlake.streaming import reads as streams

FASTA = "junk\nmore junk\n>chrA first\nACGT\nac>gt\n>chrB\r\nNNNN\r\nACG\r\n>empty\n>chrC x y\nRYK"


@pytest.mark.parametrize("split", [None, "16b"])
def test_fasta_records(spark, tmp_path, split):
    (tmp_path / "a.fasta").write_bytes(FASTA.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = fasta.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("rec_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.rec_id, r.head, r.name, r.seq, r.nchar) for r in rows] == [(0, ">chrA first", "chrA", "ACGTac>gt", 9), (1, ">chrB", "chrB", "NNNNACG", 7), (2, ">empty", "empty", "", 0), (3, ">chrC x y", "chrC", "RYK", 3)]


def test_fasta_of_several_files(spark, tmp_path):
    for i, text in enumerate((">a\nAC\n", "junk\n>b\nGG\n>c\nT", "only junk", "")):
        (tmp_path / f"{i}.fasta").write_text(text)
    rows = fasta.read_fasta(spark, str(tmp_path / "*.fasta")).orderBy("rec_id").collect()
    assert sorted((r.name, r.seq) for r in rows) == [("a", "AC"), ("b", "GG"), ("c", "T")] and [r.rec_id for r in rows] == [0, 1, 2]


def test_reads_options(spark):
    recs = spark.createDataFrame([(0, ">a", "ACNTxA"), (1, ">b", "AC")], "rec_id long, head string, seq string")
    get = lambda **o: [r.frag for r in fasta.reads(recs, 4, **o).collect()]
    assert get() == ["ACGT"] and get(junk="a") == ["ACAT"] and get(junk="drop") == ["ACGT"] and get(skip_n=True) == []
    assert get(bad="random") == get(bad="random") and len(get(bad="random")[0]) == 4
    assert fasta.keep_heads(recs, ["^>b"]).count() == 1
    with pytest.raises(ValueError):
        fasta.keep_heads(recs, ["zzz"])


def test_fasta_writer_round_trip(spark, tmp_path):
    recs = spark.createDataFrame([("a b", "ACGT"), (">c", "G" * 5000)], "head string, seq string").coalesce(1)
    fasta.write_fasta(recs, str(tmp_path / "o.fasta"))
    assert [(r.head, r.seq) for r in fasta.load(spark, str(tmp_path / "o.fasta")).collect()] == [(">a b", "ACGT"), (">c", "G" * 5000)]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\nAC\n+\n@III\nII\n@r2\nGG\n+r2\n@@\n")
    assert [(r.head, r.seq) for r in fasta.load(spark, str(tmp_path / "a.fastq")).collect()] == [("@r1 x", "ACGTAC"), ("@r2", "GG")]


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.maps").write_text(">read_1 start=1 len=5 src=a + 0.9 10 chr1 long\n>read_1 start=1 len=5 src=a - 0.8 3 >chr2\nr2 + 1 0 c\n")
    m = tables.read_maps(spark, str(tmp_path / "m.maps")).orderBy("line").collect()
    assert [(r.read, r.rank, r.strand, r.score, r.pos0, r.record) for r in m] == [("read_1", 1, "+", 0.9, 10, "chr1"), ("read_1", 2, "-", 0.8, 3, "chr2"), ("r2", 1, "+", 1.0, 0, "c")]
    (tmp_path / "bad.maps").write_text("no strand here\n")
    with pytest.raises(Exception, match="no strand"):
        tables.read_maps(spark, str(tmp_path / "bad.maps")).collect()
    (tmp_path / "p.paf").write_text("s:1:true\t9\t0\t9\t-\ts\t100\t5\textra\nshort\tline\n")
    assert [(r.qname, r.strand, r.tname, r.tlen, r.tstart) for r in tables.read_paf(spark, str(tmp_path / "p.paf")).collect()] == [("s:1:true", "-", "s", 100, 5)]
    (tmp_path / "v.tsv").write_text("id src start len\nr1 a 5 10\nr2 b x 3\nr3 c 7\n\nshort 1\n")
    assert [tuple(r) for r in tables.read_provenance(spark, str(tmp_path / "v.tsv")).collect()] == [("r1", "a", 5, 10), ("r3", "c", 7, 0)]


def test_cuts_truth_and_distances(spark, tmp_path):
    (tmp_path / "c.bin").write_bytes(struct.pack("<3f", 0.5, 0.25, 1))
    (tmp_path / "c.txt").write_text("0.5 0.25\n1")
    for name in ("c.bin", "c.txt"):
        assert [tuple(r) for r in tables.read_cuts(spark, str(tmp_path / name), 3).collect()] == [(1, 0.5), (2, 0.25), (3, 1.0)]
    with pytest.raises(Exception, match="cuts"):
        tables.read_cuts(spark, str(tmp_path / "c.txt"), 4).collect()
    (tmp_path / "t.json").write_text(json.dumps({"a": {"ref_index": 1, "pos": 9, "reverse": True}}))
    assert tuple(tables.read_truth(spark, str(tmp_path / "t.json")).first()) == ("a", 1, 9, True)
    (tmp_path / "d.json").write_text(json.dumps({"distances": [{"read_name": "r", "levenshtein_distance": 4}]}))
    assert tuple(tables.read_distances(spark, str(tmp_path / "d.json")).first()) == ("r", 4)


def test_index_and_provenance_files(spark, tmp_path):
    recs = spark.createDataFrame([(0, ">r0 x", "ACGTTGCA" * 20)], "rec_id long, head string, seq string")
    index = mapping.build_index(recs, encode.Rope(40, 3, 1, 3), 20)
    tables.write_index(index, str(tmp_path / "ix"), k=40, kstep=20)
    back, meta = tables.read_index(spark, str(tmp_path / "ix"), k=40)
    assert back.count() == index.count() and meta["kstep"] == "20"
    with pytest.raises(ValueError):
        tables.read_index(spark, str(tmp_path / "ix"), k=41)
    reads = spark.createDataFrame([(">read_1 start=3 len=4 src=a", "ACGT"), ("?", "A")], "head string, frag string")
    plain, prov = tables.split_provenance(reads)
    assert plain.count() == 1 and tuple(prov.first()) == ("read_1", "a", 3, 4)
    hits = spark.createDataFrame([(1, ">q", 1, 0, 0.5, 11, ">r0 x")], "read_id long, head string, rank int, strand int, score double, start long, record string")
    tables.write_maps(hits, str(tmp_path / "o.maps"))
    assert tables.read_maps(spark, str(tmp_path / "o.maps")).first().pos0 == 10


def test_streamed_mapping_equals_batch(spark, tmp_path):
    recs = spark.createDataFrame([(0, ">r0", "ACGTTGCAGGATCCA" * 20)], "rec_id long, head string, seq string")
    rope = encode.Rope(60, 3, 1, 3)
    index = mapping.build_index(recs, rope, 30).cache()
    reads = spark.createDataFrame([(i, ("ACGTTGCAGGATCCA" * 20)[i : i + 60]) for i in range(40)], "read_id long, frag string")
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    got = []
    stream = streams.read_stream(spark, str(tmp_path / "in"), reads.schema, 2)
    q = streams.start_mapping(stream, index, rope, lambda df, n: got.extend((r.read_id, r.rank, r.start, r.strand) for r in df.collect()), str(tmp_path / "ck"), 3)
    q.awaitTermination()
    want = [(r.read_id, r.rank, r.start, r.strand) for r in mapping.map_reads(reads, index, rope, 3).collect()]
    assert sorted(got) == sorted(want) and len(got) == 120
    assert F is not None
