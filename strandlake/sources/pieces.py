"""FASTA and FASTQ by byte ranges: a data source whose ranges cut files anywhere, also inside a record or a line.

A range is of one file; a task reads the small ones that follow each other. A range yields *pieces*: letters that
stand together in one record, with the byte they begin at, so a chromosome of
any length is many rows in many tasks. How a range begins follows from at most
``HEADER`` bytes in front of it: a range that opens inside a header line begins
after it, and the range in which the line opens reads it to its end.

What a piece can't know alone (its record's number, its place in the record)
comes from one row of totals for each partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dna
from ..shared import store_uri

#: Bytes of a range, letters of a piece, bytes of a header line at most, bytes that are read at a time.
SPLIT, PIECE, HEADER, CHUNK = 64 << 20, 1 << 16, 1 << 20, 4 << 20
#: Bytes of a task's ranges at least, tasks that a small input is dealt to; larger ones take SPLIT bytes a task.
LEAST, TASKS = 1 << 20, 64
_SCHEMA = "part long, file string, local long, lead long, offset long, head string, seq string"
_TOTALS = "part long, file string, opens long, lead long, tail long"
_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x0D]] = True


def files_of(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the file, of the folder's files, or of those that a pattern in the last part of the path names; in order of names."""
    address = store_uri(path)
    if "://" not in address:
        address = f"file://{address}"
    folder, _, last = address.rpartition("/")
    store, where = fs.FileSystem.from_uri(folder if any(c in last for c in "*?") else address)
    info = store.get_file_info(where)
    if any(c in last for c in "*?"):
        wanted = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in last) + "$")
        found = [x for x in store.get_file_info(fs.FileSelector(where)) if wanted.match(x.base_name)]
    elif info.type == fs.FileType.Directory:
        found = [x for x in store.get_file_info(fs.FileSelector(where)) if not x.base_name.startswith(("_", "."))]
    else:
        found = [info]
    scheme = address.partition("://")[0]
    held = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File)
    if not held:
        raise FileNotFoundError(path)
    return [(f"{scheme}://{p}", n) for p, n in held]


def opened(address: str) -> pa.NativeFile:
    if address.startswith("file://"):  # a local name may hold what an address may not
        return fs.LocalFileSystem().open_input_file(address[7:])
    store, where = fs.FileSystem.from_uri(address)
    return store.open_input_file(where)


@dataclass
class Range:
    part: int
    file: str
    start: int
    end: int
    size: int


@dataclass
class Stretch(InputPartition):
    """Ranges that follow each other, read by one task: (number of the first, file, its first byte, end of the last, size of the file) for each file."""

    held: list[tuple[int, str, int, int, int]]

    def __post_init__(self):
        self.value = self.held[0][0] if self.held else 0

    def ranges(self, split: int) -> Iterator[Range]:
        for part, file, start, end, size in self.held:
            for i, at in enumerate(range(start, end, split)):
                yield Range(part + i, file, at, min(at + split, size), size)


class SequencePieces(DataSource):
    """``spark.read.format("sequence_pieces")``; options path, split, piece, anywhere, kind (fasta, fastq), totals."""

    @classmethod
    def name(cls) -> str:
        return "sequence_pieces"

    def schema(self) -> str:
        if self.options.get("kind") == "fastq":
            return "part long, file string, offset long, head string, seq string"
        return _TOTALS if self.options.get("totals") == "true" else _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PieceReader(self.options)


class PieceReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split, self.piece = int(options.get("split", SPLIT)), int(options.get("piece", PIECE))
        self.anywhere, self.totals, self.kind = options.get("anywhere") == "true", options.get("totals") == "true", options.get("kind", "fasta")
        if self.split < 1 or self.piece < 1:
            raise ValueError("split and piece must be at least 1")

    def partitions(self) -> list[Stretch]:
        """Tasks by bytes: small ranges, also of different files, share one, so their number does not grow as the split shrinks."""
        files = files_of(self.path)
        wanted = min(SPLIT, max(LEAST, sum(n for _, n in files) // TASKS))
        each = max(1, wanted // self.split)
        out, held, room, part = [], [], each, 0
        for file, size in files:
            at, left = 0, -(-size // self.split)
            while left:
                n = min(left, room)
                end = min(size, at + n * self.split)
                held.append((part, file, at, end, size))
                at, left, room, part = end, left - n, room - n, part + n
                if not room:
                    out.append(Stretch(held))
                    held, room = [], each
        return [*out, Stretch(held)] if held or not out else out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        f, now = None, None
        try:
            for r in partition.ranges(self.split):
                if r.file != now:
                    if f is not None:
                        f.close()
                    f, now = opened(r.file), r.file
                if self.kind == "fastq":
                    yield from _qualities(f, r)
                elif self.totals:
                    yield _totals(f, r, self.anywhere)
                else:
                    yield from _pieces(f, r, self.piece, self.anywhere)
        finally:
            if f is not None:
                f.close()


def _begin(f, at: int, anywhere: bool) -> tuple[int, bool]:
    """(where the range's own bytes begin, whether a line opens there) for a range from ``at``."""
    if at == 0:
        return 0, True
    back = 0
    while back < min(at, HEADER):
        step = min(max(4096, back), at - back)
        f.seek(at - back - step)
        held = f.read(step)
        back += step
        cut = max(held.rfind(b"\n"), held.rfind(b"\r"))
        mark = held.rfind(b">") if anywhere else -1
        if cut < 0 and mark < 0 and back < at:
            continue
        if mark > cut:
            inside = True
        elif cut >= 0:
            if cut == len(held) - 1 and back == step:
                return at, True
            f.seek(at - back + cut + 1)
            inside = f.read(1) == b">"
        else:
            inside = held[:1] == b">"  # the file's first line
        break
    else:
        inside = False
    return (_line_end(f, at, anywhere), True) if inside else (at, False)


def _line_end(f, at: int, anywhere: bool) -> int:
    """The place of the line end, or of what opens the next record, that ends a header which ``at`` stands in."""
    f.seek(at)
    done = 0
    while held := f.read(4096):
        found = re.search(rb"[\n\r>]" if anywhere else rb"[\n\r]", held)
        if found:
            return at + done + found.start()
        done += len(held)
        if done > HEADER:
            raise ValueError(f"a header line of more than {HEADER} bytes")
    return at + done


def _scan(f, p: Range, anywhere: bool) -> Iterator[tuple[int, str | None, bytes | np.ndarray, np.ndarray]]:
    """(offset, header or None, letters, their offsets) of stretches between headers, a chunk at a time."""
    at, fresh = _begin(f, p.start, anywhere)
    mark = rb">" if anywhere else rb"(?:(?<=[\n\r])|\A)>"
    while at < p.end:
        # A chunk begins at a line start only if the byte before it ends a line.
        f.seek(at)
        held = f.read(min(CHUNK, p.end - at))
        if not held:
            return
        cut = 0
        for m in re.finditer(mark, held):
            if m.start() < cut or (m.start() == 0 and not (fresh or anywhere)):
                continue
            yield from _letters(at + cut, held[cut : m.start()])
            end = _line_end(f, at + m.start() + 1, anywhere)
            f.seek(at + m.start())
            yield at + m.start(), f.read(end - at - m.start()).decode("utf-8", "replace"), b"", None
            cut = end - at
        if cut < len(held):
            yield from _letters(at + cut, held[cut:])
        at += max(cut, len(held))
        fresh = held[-1:] in (b"\n", b"\r") if cut <= len(held) else False


def _letters(offset: int, held: bytes):
    data = np.frombuffer(held, np.uint8)
    keep = np.flatnonzero(~_BREAK[data])
    if len(keep):
        yield offset, None, data[keep], offset + keep


def _pieces(f, p: Range, piece: int, anywhere: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = local = lead = 0
    for offset, head, letters, places in _scan(f, p, anywhere):
        if head is not None:
            local, lead = local + 1, 0
            rows.append((p.part, p.file, local, 0, offset, head, ""))
            size += len(head)
        else:
            at = 0
            while at < len(letters):
                end = min(len(letters), at + piece)
                rows.append((p.part, p.file, local, lead, int(places[at]), None, letters[at:end].tobytes()))
                lead, size, at = lead + end - at, size + end - at, end
        if size > CHUNK or len(rows) > 4096:
            yield _rows(rows)
            rows, size = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, file, local, lead, offset, head, seq = zip(*rows)
    text = [s if isinstance(s, str) else s.decode("latin-1") for s in seq]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(file, pa.string()), pa.array(local, pa.int64()), pa.array(lead, pa.int64()), pa.array(offset, pa.int64()), pa.array(head, pa.string()), pa.array(text, pa.string())], ["part", "file", "local", "lead", "offset", "head", "seq"])


def _totals(f, p: Range, anywhere: bool) -> pa.RecordBatch:
    opens = lead = tail = 0
    for _, head, letters, _ in _scan(f, p, anywhere):
        if head is not None:
            opens, tail = opens + 1, 0
        elif opens:
            tail += len(letters)
        else:
            lead += len(letters)
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in (p.part, p.file, opens, lead, tail)], ["part", "file", "opens", "lead", "tail"])


def read_pieces(spark: SparkSession, path: str, split: int = SPLIT, piece: int = PIECE, anywhere: bool = False) -> DataFrame:
    """rec_id, head (of a record's first piece), at, offset, file, seq: the records of ``path`` in pieces, at any ``split``.

    ``at`` is the place of the piece's first letter in its record, from 1, and
    ``offset`` its byte in ``file``. A record's first piece holds its header and
    no letters, so empty records are there too. Letters in front of a file's
    first record go. A letter is a byte (Latin-1); headers are UTF-8.

    The totals that number records and letters are one row for each range;
    they are added up in the driver and go out again, three numbers for each.
    """
    spark.dataSource.register(SequencePieces)
    options = {"path": path, "split": str(split), "piece": str(piece), "anywhere": str(anywhere).lower()}
    reader = lambda **more: spark.read.format("sequence_pieces").options(**options, **more).load()
    base, records, carried, now = [], 0, 0, None
    for r in reader(totals="true").orderBy("part").collect():
        if r["file"] != now:
            now, carried, open_ = r["file"], 0, False
        base.append((r["part"], records, carried, open_))
        carried = r["tail"] if r["opens"] else carried + r["lead"]
        open_ = open_ or r["opens"] > 0
        records += r["opens"]
    before = F.broadcast(spark.createDataFrame(base, "part long, before long, carried long, open boolean"))
    rows = reader().join(before, "part").filter((F.col("local") > 0) | F.col("open"))
    at = F.when(F.col("local") == 0, F.col("carried")).otherwise(0) + F.col("lead") + 1
    return rows.select((F.col("before") + F.col("local") - 1).alias("rec_id"), "head", at.alias("at"), "offset", "file", "seq")


def blocks_of(pieces: DataFrame, size: int = PIECE, overlap: int = 0) -> DataFrame:
    """rec_id, block (from 0), text: the letters from block * size + 1 on, ``size`` + ``overlap`` of them at most.

    Each piece goes to the blocks that it has letters of, so a block is put
    together from few pieces however long its record is. ``overlap`` lets
    windows that begin in a block lie in it whole. Empty records have no block.
    """
    rows = pieces.filter(F.length("seq") > 0).select("rec_id", (F.col("at") - 1).alias("a"), (F.col("at") - 1 + F.length("seq")).alias("e"), "seq")
    first = F.greatest(F.lit(0), F.floor((F.col("a") - overlap) / size))
    each = rows.select("rec_id", "a", "e", "seq", F.explode(F.sequence(first.cast("long"), F.floor((F.col("e") - 1) / size).cast("long"))).alias("block"))
    low, high = F.greatest("a", F.col("block") * size), F.least("e", (F.col("block") + 1) * size + overlap)
    cut = each.filter(low < high).select("rec_id", "block", low.alias("low"), F.substring("seq", (low - F.col("a") + 1).cast("int"), (high - low).cast("int")).alias("text"))
    parts = cut.groupBy("rec_id", "block").agg(F.array_sort(F.collect_list(F.struct("low", "text"))).alias("parts"))
    whole = parts.select("rec_id", "block", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return whole.filter((F.lit(overlap) == 0) | (F.length("text") > 0))


def windows_of(pieces: DataFrame, k: int, kstep: int, size: int = PIECE) -> DataFrame:
    """rec_id, start, frag: the windows of ``k`` letters at 1, 1 + kstep, ... of every record, cut from overlapping blocks."""
    span = -(-max(size, kstep) // kstep) * kstep
    held = blocks_of(pieces, span, k - 1).filter(F.length("text") >= k)
    starts = F.sequence(F.lit(1), F.least(F.length("text") - k + 1, F.lit(span - kstep + 1)), F.lit(kstep))
    return held.select("rec_id", "block", F.posexplode(dna.cut("text", starts, k)).alias("i", "frag")).select("rec_id", (F.col("block") * span + F.col("i") * kstep + 1).cast("long").alias("start"), "frag")


def summary(pieces: DataFrame) -> DataFrame:
    """rec_id, head, name, nchar of every record; only lengths are shuffled."""
    rows = pieces.groupBy("rec_id").agg(F.max("head").alias("head"), F.sum(F.length("seq")).cast("long").alias("nchar"))
    return rows.select("rec_id", "head", dna.record_name("head").alias("name"), "nchar")


def offsets(pieces: DataFrame) -> DataFrame:
    """rec_id, at, n, offset, file of every piece with letters: the index that ``seek`` reads. Write it once."""
    return pieces.filter(F.length("seq") > 0).select("rec_id", "at", F.length("seq").cast("long").alias("n"), "offset", "file")


def seek(index: DataFrame, places: DataFrame, piece: int = PIECE) -> DataFrame:
    """``places`` (rec_id, start from 1, k) with ``frag``, read from the files themselves at the bytes that ``index`` names.

    ``piece`` must be that of the index: a place meets a piece in a bin of so
    many letters. Only the bytes of the pieces that a place touches are read.
    """
    bins = lambda a, e: F.explode(F.sequence(F.floor((a - 1) / piece).cast("long"), F.floor((e - 1) / piece).cast("long")))
    wanted = places.select("rec_id", "start", "k").distinct().filter("k > 0 and start >= 1")
    asked = wanted.select("*", bins(F.col("start"), F.col("start") + F.col("k") - 1).alias("bin"))
    held = index.select("*", bins(F.col("at"), F.col("at") + F.col("n") - 1).alias("bin"))
    touched = asked.join(held, ["rec_id", "bin"]).filter((F.col("at") < F.col("start") + F.col("k")) & (F.col("start") < F.col("at") + F.col("n"))).drop("bin").distinct()

    def run(batches):
        last, f = None, None
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                if r["file"] != last:
                    if f is not None:
                        f.close()
                    last, f = r["file"], opened(r["file"])
                skip, need = max(0, r["start"] - r["at"]), min(r["start"] + r["k"], r["at"] + r["n"]) - r["at"]
                f.seek(r["offset"])
                got = np.zeros(0, np.uint8)
                while len(got) < need and (more := f.read(need - len(got) + 64)):
                    data = np.frombuffer(more, np.uint8)
                    got = np.concatenate((got, data[~_BREAK[data]]))
                texts.append(got[skip:need].tobytes().decode("latin-1"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rec_id", "start", "k", "at")), pa.array(texts, pa.string())], ["rec_id", "start", "k", "at", "text"])
        if f is not None:
            f.close()

    found = touched.sortWithinPartitions("file", "offset").mapInArrow(run, "rec_id long, start long, k long, at long, text string")
    parts = found.groupBy("rec_id", "start", "k").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    frag = parts.select("rec_id", "start", "k", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("frag"))
    return places.join(frag, ["rec_id", "start", "k"], "left").withColumn("frag", F.coalesce("frag", F.lit("")))


# --- FASTQ -------------------------------------------------------------------


class Lines:
    """Lines of a file from a byte on, with their offsets, without their ends; a chunk is held at a time."""

    def __init__(self, f, at: int):
        self.f, self.at, self.held, self.done = f, at, b"", False

    def next(self) -> tuple[int, bytes] | None:
        while True:
            found = re.search(rb"\r\n|\n|\r(?=.)", self.held, re.S) or (re.search(rb"\r", self.held) if self.done else None)
            if found:
                line = self.at, self.held[: found.start()]
                self.at, self.held = self.at + found.end(), self.held[found.end() :]
                return line
            if self.done:
                line, self.held = (self.at, self.held), b""
                self.at += len(line[1])
                return line if line[1] else None
            self.f.seek(self.at + len(self.held))
            more = self.f.read(max(1 << 16, len(self.held)))
            self.held, self.done = self.held + more, not more


def _record(lines: Lines, first: tuple[int, bytes] | None) -> tuple[tuple[int, bytes, bytes] | None, tuple[int, bytes] | None]:
    """(offset, head, sequence) of the record that opens at line ``first`` (None if none does), and the line after it."""
    if first is None or not first[1].startswith(b"@"):
        return None, first
    seq = b""
    while (line := lines.next()) is not None and not line[1].startswith(b"+"):
        seq += line[1].strip()
        if line[1].startswith(b"@"):
            return None, line
    if line is None:
        return None, None
    passed, line = 0, lines.next()
    while passed < len(seq) and line is not None:
        passed += len(line[1].strip())
        line = lines.next()
    return ((*first, seq) if passed == len(seq) else None), line


#: Records that must follow each other for a place to be taken for a record's begin.
IN_A_ROW = 3
#: What their sequences are made of.
BASES = re.compile(rb"[A-Za-z*.-]+")


def _opens(f, at: int) -> bool:
    """Whether records follow each other from the line at ``at``, to the end of the file or IN_A_ROW of them."""
    lines = Lines(f, at)
    line = lines.next()
    for n in range(IN_A_ROW):
        if line is None:
            return n > 0
        got, line = _record(lines, line)
        if got is None or not BASES.fullmatch(got[2]):
            return False
        while line is not None and not line[1].strip():
            line = lines.next()
    return line is None or line[1].startswith(b"@")


def _qualities(f, p: Range) -> Iterator[pa.RecordBatch]:
    """The FASTQ records that open in the range. Quality lines may begin with ``@``: what follows tells them from headers."""
    lines = Lines(f, max(0, p.start - 1))
    line = lines.next()
    if p.start:
        # The line that holds the byte before the range is another's, unless that byte ends it.
        line = lines.next()
        while line is not None and line[0] < p.end and not (line[1].startswith(b"@") and _opens(f, line[0])):
            line = lines.next()
    rows: list[tuple] = []
    size = 0
    while line is not None and line[0] < p.end:
        got, line = _record(lines, line) if line[1].startswith(b"@") else (None, lines.next())
        if got:
            rows.append(got)
            size += len(got[2])
        if size > CHUNK:
            yield _reads(p, rows)
            rows, size = [], 0
    if rows:
        yield _reads(p, rows)


def _reads(p: Range, rows: list[tuple]) -> pa.RecordBatch:
    at, head, seq = zip(*rows)
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([p.part] * n, pa.int64()), pa.array([p.file] * n), pa.array(at, pa.int64()), pa.array([h.decode("latin-1") for h in head]), pa.array([s.decode("latin-1") for s in seq])], ["part", "file", "offset", "head", "seq"])


def read_reads(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, offset, head, seq of FASTQ records, whatever the split; sequence and quality may take several lines.

    A record belongs to the range that its header line opens in, and is read to
    its end from there. A range finds its first record by trying lines that
    begin with ``@``: the one from which whole records follow each other. A
    record whose quality is shorter or longer than its sequence is left out.
    """
    spark.dataSource.register(SequencePieces)
    return spark.read.format("sequence_pieces").options(path=path, split=str(split), kind="fastq").load().select("file", "offset", "head", "seq")


def number_reads(reads: DataFrame) -> DataFrame:
    """``reads`` with ``read_ord`` from 0 in the order of files and bytes, by totals of files and of ranges of bytes: no window holds more than a range."""
    span = F.floor(F.col("offset") / SPLIT).alias("span")
    counts = reads.groupBy("file", span).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("file", "span")) - F.col("n")  # one row for each range
    base = counts.select("file", "span", upto.alias("before"))
    placed = reads.withColumn("span", span).withColumn("i", F.row_number().over(W.partitionBy("file", "span").orderBy("offset")))
    return placed.join(base, ["file", "span"]).select((F.col("before") + F.col("i") - 1).alias("read_ord"), "file", "offset", "head", "seq")
