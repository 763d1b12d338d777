"""Byte ranges of FASTA and FASTQ against the plain reading of the whole file."""

import random
import re

import pytest

from strandlake.sources import pieces


def plain_fasta(data, anywhere=False):
    """(head, sequence) of every record of one file."""
    text = data.decode("latin-1")
    marks = [m.start() for m in re.finditer(">" if anywhere else r"(?:(?<=[\n\r])|\A)>", text)]
    out, at = [], 0
    for i, m in enumerate(marks):
        if m < at:
            continue
        end = re.compile(r"[\n\r>]|\Z" if anywhere else r"[\n\r]|\Z").search(text, m + 1).start()
        stop = next((x for x in marks[i + 1 :] if x >= end), len(text))
        out.append((text[m:end], re.sub("[\n\r]", "", text[end:stop])))
        at = end
    return out


def joined(rows):
    heads, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (r["rec_id"], r["at"], r["head"] is None)):
        if r["head"] is not None:
            assert r["rec_id"] not in heads
            heads[r["rec_id"]] = r["head"]
        held = seqs.get(r["rec_id"], "")
        assert r["at"] == len(held) + 1
        seqs[r["rec_id"]] = held + r["seq"]
    return [(heads[i], seqs[i]) for i in range(len(heads))]


def sample(seed):
    r = random.Random(seed)
    out = b"junk before\n" if seed % 2 else b""
    for i in range(12):
        seq = "".join(r.choice("ACGTNacgt>") for _ in range(r.choice([0, 1, 30, 200, 900])))
        width, end = r.choice([7, 60, 5000]), r.choice(["\n", "\r\n", "\r"])
        seq = seq.lstrip(">") if width > 900 else seq.replace(">", "A")
        lines = [seq[s : s + width] for s in range(0, len(seq), width)]
        out += f">rec{i} {'x' * r.choice([0, 3, 80])} a>b".encode() + end.encode() + "".join(x + end for x in lines).encode()
    return out + (b">last\nACG" if seed % 3 else b">")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("anywhere", [False, True])
def test_ranges_of_any_size_give_the_whole_files_records(tmp_path, seed, anywhere):
    data = sample(seed)
    (tmp_path / "a.fasta").write_bytes(data)
    want = plain_fasta(data, anywhere)
    for split in (1, 2, 3, 17, 61, 500, 10**6):
        reader = pieces.PieceReader({"path": str(tmp_path / "a.fasta"), "split": str(split), "piece": "13", "anywhere": str(anywhere).lower()})
        records, letters = [], []
        for p in reader.partitions():
            for batch in reader.read(p):
                for r in batch.to_pylist():
                    if r["head"] is not None:
                        records.append(r["head"])
                        letters.append("")
                    elif records:
                        letters[-1] += r["seq"]
                        assert len(r["seq"]) <= 13 and data[r["offset"] : r["offset"] + 1].decode("latin-1") == r["seq"][0]
        assert list(zip(records, letters)) == want, split


@pytest.mark.parametrize("split", [40, 333, 10**6])
def test_numbers_and_places_over_files(spark, tmp_path, split):
    for i in range(3):
        (tmp_path / f"{i}.fasta").write_bytes(sample(i))
    (tmp_path / "_SUCCESS").write_bytes(b">no\nACGT")
    found = pieces.read_pieces(spark, str(tmp_path), split, 50)
    want = [x for i in range(3) for x in plain_fasta(sample(i))]
    assert joined(found.collect()) == want
    assert [(r["head"], r["nchar"]) for r in pieces.summary(found).orderBy("rec_id").collect()] == [(h, len(s)) for h, s in want]
    frags = {(r["rec_id"], r["start"]): r["frag"] for r in pieces.windows_of(found, 20, 7, 35).collect()}
    assert frags == {(i, s + 1): q[s : s + 20] for i, (_, q) in enumerate(want) for s in range(0, len(q) - 19, 7)}
    some = pieces.read_pieces(spark, str(tmp_path / "[0-1].fasta").replace("[0-1]", "?"), split, 50)
    assert joined(some.collect()) == want


def test_seek_reads_the_places_bytes(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(sample(5))
    want = plain_fasta(sample(5))
    found = pieces.read_pieces(spark, str(tmp_path / "a.fasta"), 100, 40)
    places = [(i, s, k) for i in range(len(want)) for s, k in ((1, 10), (30, 100), (150, 700), (5000, 3), (1, 0))]
    got = pieces.seek(pieces.offsets(found), spark.createDataFrame(places, "rec_id long, start long, k long"), 40).collect()
    assert {(r["rec_id"], r["start"], r["k"]): r["frag"] for r in got} == {(i, s, k): want[i][1][s - 1 : s - 1 + k] for i, s, k in places}


def fastq_file(seed):
    r = random.Random(seed)
    out, want = b"", []
    for i in range(60):
        seq = "".join(r.choice("ACGT") for _ in range(r.choice([1, 4, 50, 300])))
        quality = "".join(r.choice("@+I#>") for _ in seq)
        width = r.choice([60, 1000])
        cut = lambda x: "".join(x[s : s + width] + "\n" for s in range(0, len(x), width))  # noqa: E731, B023
        out += f"@r{i} y\n{cut(seq)}+{r.choice(['', 'r'])}\n{cut(quality)}".encode()
        want.append((f"@r{i} y", seq))
    return out, want


@pytest.mark.parametrize("seed", range(5))
def test_fastq_ranges(tmp_path, seed):
    data, want = fastq_file(seed)
    data = data.replace(b"\n", b"\r\n") if seed % 2 else data
    (tmp_path / "a.fastq").write_bytes(data)
    for split in (1, 13, 100, 777, 10**6):
        reader = pieces.PieceReader({"path": str(tmp_path / "a.fastq"), "split": str(split), "kind": "fastq"})
        got = [(r["head"], r["seq"]) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert got == want, split


def test_fastq_numbers(spark, tmp_path):
    wants = []
    for i in range(2):
        data, want = fastq_file(i)
        (tmp_path / f"{i}.fastq").write_bytes(data)
        wants += want
    found = pieces.number_reads(pieces.read_reads(spark, str(tmp_path), 500)).orderBy("read_ord").collect()
    assert [(r["read_ord"], r["head"], r["seq"]) for r in found] == [(i, *w) for i, w in enumerate(wants)]


def test_wrong_paths_and_long_headers(tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        pieces.files_of(str(tmp_path / "none.fasta"))
    monkeypatch.setattr(pieces, "HEADER", 10_000)
    (tmp_path / "a.fasta").write_bytes(b">" + b"x" * 30_000 + b"\nACGT\n")
    reader = pieces.PieceReader({"path": str(tmp_path / "a.fasta")})
    with pytest.raises(ValueError, match="header"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_empty_file(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b"")
    assert pieces.read_pieces(spark, str(tmp_path / "a.fasta")).count() == 0


def test_small_ranges_share_tasks(tmp_path):
    """The number of tasks follows from bytes; the ranges, their numbers and their rows stay those of the split."""
    for i in range(3):
        (tmp_path / f"{i}.fa").write_bytes(b"".join(b">r%d_%d\n" % (i, j) + b"ACGT" * 50 + b"\n" for j in range(600)))
    reader = pieces.PieceReader({"path": str(tmp_path), "split": "100"})
    tasks = reader.partitions()
    ranges = [r for t in tasks for r in t.ranges(100)]
    assert len(tasks) <= 2 and [r.part for r in ranges] == list(range(len(ranges)))
    assert [(r.file, r.start, r.end) for r in ranges] == [(f, s, min(s + 100, n)) for f, n in pieces.files_of(str(tmp_path)) for s in range(0, n, 100)]
    heads = [r["head"] for t in tasks for b in reader.read(t) for r in b.to_pylist() if r["head"]]
    assert heads == [f">r{i}_{j}" for i in range(3) for j in range(600)]


def test_a_quality_file_is_no_row(spark, tmp_path, monkeypatch):
    """Files are read a chunk at a time by their names; what the scan hands over has no content."""
    from strandlake.sources import fasta

    r = random.Random(8)
    want, data = [], b""
    for i in range(3000):
        seq = "".join(r.choice("ACGT") for _ in range(r.choice([0, 1, 39, 90])))
        want.append((f"@r {i}", seq))
        data += f"@r {i}\n{seq[:40]}\n{seq[40:]}\n+\n{'@' * len(seq[:40])}\n{'@' * len(seq[40:])}\n".replace("\n", ["\n", "\r\n"][i % 2]).encode()
    (tmp_path / "a b.fq").write_bytes(b"junk\n" + data)
    (tmp_path / "empty.fq").write_bytes(b"")
    monkeypatch.setattr(pieces, "CHUNK", 1000)
    got = fasta.read_fastq(spark, str(tmp_path))
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
