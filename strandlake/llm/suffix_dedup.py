"""Exact removal of long repeated byte strings.

Column-wise multi-document construction takes one round for each column, so
running it on whole texts would take as many rounds as the longest text has
bytes, each over everything built so far. Here it runs on pieces of bounded
length instead, and no match is lost by that:

* Winnowing picks anchors: of every window of ``length - ANCHOR + 1``
  neighbouring ANCHOR-byte strings the one with the least hash (the first of
  equals). The choice depends on the window's bytes alone, so equal windows of
  ``length`` bytes have equal anchors at equal places.
* Anchors whose hash occurs once in the corpus are done: their windows are
  unique. For the others, the bytes around the anchor that its windows can
  reach are cut out as a piece of at most 2 * length - ANCHOR bytes.
* Pieces of one anchor meet in one task. There the collection's transform is
  built column by column: each round takes the transform of the round before,
  which is the symbol that precedes every suffix, inserts it, and updates the
  order, the common prefixes between neighbours and the transform's next column.
  They go to files in the shared folder that are written once and read once, in
  sequence. Windows of equal bytes stand in the same column next to each other
  with a common prefix of at least ``length``.
* Anchors with more than CROWD different pieces are split by further columns:
  the windows that begin between two of CUTS before the anchor all hold the
  same bytes around it, so pieces that differ there need not meet. Within a
  range only the bytes that its windows reach are kept, which makes many pieces
  one. A range that is still crowded is split down to single starts, where a part
  is a window and equal ones are one part: they are counted and nothing is left
  to sort.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import store_uri
from .common import POWERS, U64, Workspace, as_long, bounded_batches, mix, row_count, texts_of

LENGTH, ANCHOR = 200, 64
#: Different pieces of an anchor above which it is split, and the ranges of window starts (bytes before the anchor, mirrored) it is split into.
CROWD, CUTS = 4096, (0, 2, 8, 24, 44)
#: Rows of 16-byte keys up to which a counted table is broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 300_000
#: Bytes of text hashed at once; a longer text is taken in overlapping parts.
PART = 1 << 20


def anchors(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text; none below ``length`` bytes."""
    places, hashes = [], []
    step = PART
    for first in range(0, max(1, len(text) - length + 1), step):
        part = np.frombuffer(text[first : first + step + length - 1], np.uint8)
        if len(part) < length:
            break
        up, down = POWERS.upto(len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=total[1:])
        grams = len(part) - anchor + 1
        h = mix((total[anchor:] - total[:-anchor]) * down[:grams])
        # The hash's upper bits and then the place: the least is the first of equals.
        key = (h & ~U64(0x1FFFFF)) | np.arange(grams, dtype=U64)
        width, have = length - anchor + 1, 1
        while have < width:
            move = min(have, width - have)
            key = np.minimum(key[:-move], key[move:])
            have += move
        at = np.unique(key & U64(0x1FFFFF)).astype(np.int64)
        places.append(at + first)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    place, which = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[which]


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            texts, key = texts_of(batch.column("text")), batch.column("key")
            found = [anchors(t, length) for t in texts]
            n = [len(p) for p, _ in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(np.repeat(np.arange(len(texts)), n))), pa.array(np.concatenate([p for p, _ in found])), pa.array(as_long(np.concatenate([h for _, h in found])))],
                    ["key", "place", "anchor"],
                )

    return run


class Columns:
    """The collection transform of pieces around one or more anchors, built column by column.

    Pieces are right-aligned so that the last symbol of each goes in first.
    ``rounds`` yields (column, order, common prefix with the one before,
    transform) after every inserted symbol: the transform has the symbol that
    precedes each suffix plus one, 0 where there is none. The state between
    rounds is these three, which are read from and written to files in sequence.
    """

    def __init__(self, symbols: np.ndarray, valid: np.ndarray, groups: np.ndarray, folder: str):
        # One row for each column: what precedes the suffixes that begin one column later.
        self.columns = np.ascontiguousarray(np.where(valid, symbols.astype(np.int16) + 1, 0).T)
        self.groups = groups
        self.store, self.folder = fs.FileSystem.from_uri(store_uri(folder))

    def _write(self, k: int, order: np.ndarray, lcp: np.ndarray, transform: np.ndarray) -> None:
        # A name of its own for each column: file systems may wait for the disk when a file is written over.
        with self.store.open_output_stream(f"{self.folder}/column-{k}") as f:
            f.write(order.astype(np.int32).tobytes() + lcp.astype(np.int16).tobytes() + transform.astype(np.int16).tobytes())

    def _read(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with self.store.open_input_stream(f"{self.folder}/column-{k}") as f:
            held = f.read()
        self.store.delete_file(f"{self.folder}/column-{k}")
        return np.frombuffer(held, np.int32, n), np.frombuffer(held, np.int16, n, 4 * n), np.frombuffer(held, np.int16, n, 6 * n)

    def _before(self, order: np.ndarray, column: int) -> np.ndarray:
        """The symbols in front of ``column`` in this order."""
        return self.columns[column - 1][order] if column else np.zeros(len(order), np.int16)

    def rounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        width, n = self.columns.shape
        # Before the first round the suffixes are empty: equal within an anchor's group.
        order = np.argsort(self.groups, kind="stable")
        held = self.groups[order]
        lcp = np.zeros(n, np.int16)
        start = np.r_[True, held[1:] != held[:-1]]
        lcp[start] = -1  # another group: nothing in common, not even the empty string
        self.store.create_dir(self.folder, recursive=True)
        try:
            self._write(0, order, lcp, self._before(order, width))
            for k, column in enumerate(range(width - 1, -1, -1), 1):
                order, lcp, transform = self._read(k - 1, n)
                order, lcp = insert(transform, order, lcp)
                transform = self._before(order, column)
                self._write(k, order, lcp, transform)
                yield column, order, lcp, transform
        finally:
            self.store.delete_dir(self.folder)


def insert(transform: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the order and common prefixes of suffixes that the transform's symbols now begin.

    Groups (runs that an lcp of -1 begins) stay together. A piece without a
    symbol in this column has nothing in common with any other.
    """
    n = len(order)
    start = lcp < 0
    group = np.cumsum(start, dtype=np.int32) - 1
    # Stable sorts by symbol and then by group; of 16-bit numbers they take linear time.
    move = np.argsort(transform, kind="stable")
    move = move[np.argsort(group[move].astype(np.uint16) if group[-1] < 1 << 16 else group[move], kind="stable")]
    key = group * 257 + transform
    # The least prefix on the way from one entry to the next of the same symbol.
    out = np.zeros(n, np.int16)
    sorted_key = key[move]
    same = np.r_[False, sorted_key[1:] == sorted_key[:-1]]
    if same.any():
        at = np.flatnonzero(same)
        low, high = move[at - 1] + 1, move[at]
        out[at] = range_minimum(lcp, low, high) + 1
    out[sorted_key % 257 == 0] = 0
    out[start] = -1  # groups stay where they are
    return order[move], out


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included, for many ranges: a sparse table of powers of two."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, row = np.empty(len(low), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if (now := level == k).any():
            out[now] = np.minimum(row[low[now]], row[high[now] - (1 << k) + 1])
        if len(row) > 1 << k:
            row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


def repeated(pieces: list[bytes], centre: np.ndarray, groups: np.ndarray, length: int, anchor: int, folder: str) -> np.ndarray:
    """(pieces, length - anchor + 1) booleans: the window that begins so many bytes before the anchor stands in another piece too."""
    reach = length - anchor
    width = 2 * reach + anchor
    symbols, valid = np.zeros((len(pieces), width), np.uint8), np.zeros((len(pieces), width), bool)
    for i, (p, c) in enumerate(zip(pieces, centre)):
        symbols[i, reach - c : reach - c + len(p)] = np.frombuffer(p, np.uint8)
        valid[i, reach - c : reach - c + len(p)] = True
    out = np.zeros((len(pieces), reach + 1), bool)
    for column, order, lcp, _ in Columns(symbols, valid, groups, f"{folder}/{uuid.uuid4().hex}").rounds():
        if column <= reach:
            near = lcp >= length
            both = near | np.r_[near[1:], False]
            out[order[both], reach - column] = True
    return out


def _pieces(length: int, anchor: int):
    reach = length - anchor

    def run(batches):
        for batch in batches:
            texts, keys = texts_of(batch.column("text")), batch.column("key")
            owner, place, mark, centre, piece, kind = [], [], [], [], [], []
            for i, (text, marks) in enumerate(zip(texts, batch.column("marks").to_pylist())):
                for m in marks:
                    p, first = m["place"], max(0, m["place"] - reach)
                    cut = text[first : p + anchor + reach]
                    owner.append(i)
                    place.append(p)
                    mark.append(m["anchor"])
                    centre.append(p - first)
                    piece.append(cut)
                    kind.append(hashlib.blake2b(cut, digest_size=16, salt=(p - first).to_bytes(2, "big")).digest())
            if owner:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(place, pa.int64()), pa.array(mark, pa.int64()), pa.array(kind, pa.binary()), pa.array(centre, pa.int32()), pa.array(piece, pa.binary())], ["key", "place", "anchor", "kind", "centre", "piece"])

    return run


def _runs(row: np.ndarray) -> list[dict]:
    """Runs (s, e) of the set columns of one piece: bytes before the anchor, from and to."""
    at = np.flatnonzero(row)
    cut = np.flatnonzero(np.diff(at) > 1)
    return [{"s": int(h), "e": int(t)} for h, t in zip(np.r_[at[:1], at[cut + 1]], np.r_[at[cut], at[-1:]])]


_RUNS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def whole(centre: int, size: int, length: int, anchor: int) -> tuple[int, int]:
    """Bytes before the anchor at which windows of this piece may begin: least and most."""
    return max(0, centre + length - size), min(centre, length - anchor)


def _build(length: int, anchor: int, folder: str, most: int = 20_000):
    """Takes whole groups together, about ``most`` pieces at a time; rows come sorted by group."""

    def flush(rows: list[tuple]):
        groups = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        flags = repeated([r[3] for r in rows], np.array([r[2] for r in rows]), groups, length, anchor, folder)
        for i, r in enumerate(rows):
            if r[4] > 1:
                least, last = whole(r[2], len(r[3]), length, anchor)
                flags[i, least : last + 1] = True
        kept = np.flatnonzero(flags.any(1)).tolist()
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in kept], pa.int64()), pa.array([rows[i][1] for i in kept], pa.binary()), pa.array([_runs(flags[i]) for i in kept], _RUNS)], ["anchor", "kind", "runs"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "kind", "centre", "piece", "copies"))):
                if len(rows) >= most and row[0] != rows[-1][0]:
                    yield from flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from flush(rows)

    return run


def ranges(reach: int) -> list[tuple[int, int]]:
    """The ranges of window starts that a crowded anchor is split into: bytes before it, least and most."""
    left = [c for c in CUTS if 2 * c <= reach]
    edges = sorted({*left, *(reach + 1 - c for c in left), reach // 2})
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def _split(length: int, anchor: int):
    """The parts of a crowded anchor's pieces, one for each range: the group they meet in, and the bytes that count there."""
    reach = length - anchor

    def run(batches):
        for batch in batches:
            owner, group, centre, piece, kind = [], [], [], [], []
            for i, (mark, c, held) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("anchor", "centre", "piece")))):
                least, last = whole(c, len(held), length, anchor)
                for a, b in ranges(reach):
                    if max(a, least) > min(b, last):
                        continue
                    b_, a_ = min(b, last), max(a, least)
                    # All windows of the range hold the ``a`` bytes before the anchor and ``reach - b`` behind it.
                    same = held[c - a : c + anchor + reach - b]
                    part = held[c - b_ : c - a_ + length]
                    name = hashlib.blake2b(same, digest_size=8, salt=a.to_bytes(2, "big"), key=mark.to_bytes(8, "big", signed=True)).digest()
                    owner.append(i)
                    group.append(int.from_bytes(name, "big", signed=True))
                    centre.append(b_)
                    piece.append(part)
                    kind.append(hashlib.blake2b(part, digest_size=16, salt=b_.to_bytes(2, "big")).digest())
            if owner:
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(take) for x in ("anchor", "kind", "copies")), pa.array(group, pa.int64()), pa.array(kind, pa.binary()), pa.array(centre, pa.int32()), pa.array(piece, pa.binary())], ["anchor", "kind", "copies", "group", "part", "centre", "piece"])

    return run


def _starts(length: int, anchor: int):
    """Every window of a part, with its bytes before the anchor and its digest."""

    def run(batches):
        for batch in batches:
            owner, before, digest = [], [], []
            for i, (c, piece) in enumerate(zip(batch.column("centre").to_pylist(), batch.column("piece").to_pylist())):
                least, last = whole(c, len(piece), length, anchor)
                for b in range(least, last + 1):
                    owner.append(i)
                    before.append(b)
                    digest.append(hashlib.blake2b(piece[c - b : c - b + length], digest_size=16, salt=b.to_bytes(2, "big")).digest())
            if owner:
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(take) for x in ("row", "copies")), pa.array(before, pa.int32()), pa.array(digest, pa.binary())], ["row", "copies", "before", "digest"])

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
            for text, copies, runs in zip(texts, batch.column("copies").to_pylist(), batch.column("runs").to_pylist()):
                spans = [(0, len(text))] if copies > 1 and len(text) >= length else covered(runs or [], length)
                left, at = [], 0
                for s, e in spans:
                    left.append(text[at:s])
                    at = e
                left = b"".join([*left, text[at:]])
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(spans))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def covered(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows with these starts (first, last) cover."""
    out: list[tuple[int, int]] = []
    for r in sorted(runs, key=lambda r: r["s"]):
        s, e = r["s"], r["e"] + length
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row of ``docs`` (doc_id, text).

    A byte goes if a ``length``-byte string that covers it also starts anywhere
    else, in the same row or another. Texts are UTF-8 bytes, null is empty and
    matches never cross rows. A repeated row counts as another document, so all
    its bytes go if it has ``length`` of them. Null ids are kept as they are.
    An empty table gives an empty result; extra columns are ignored.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be more than {ANCHOR}")
    spark = docs.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "repeats")
    # Rows with equal texts share one key; only one of them goes on as a document.
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    long_ = keyed.filter(F.octet_length("text") >= length)
    copies = space.save(long_.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("head")).filter("copies > 1"), "copies")
    n_copies = row_count(copies)
    heads = _held(copies.select("key", "head"), n_copies, "key")
    one = long_.join(heads, "key", "left_anti").unionByName(long_.join(heads, "key").filter(F.col("doc_id").eqNullSafe(F.col("head"))).drop("head")) if n_copies else long_
    marks = space.save(one.mapInArrow(_anchors(length), "key binary, place long, anchor long"), "marks")
    # Written, so that the join below shuffles it by itself and may split the marks of a crowded anchor.
    several = space.save(marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "several")
    marks = marks.join(several, "anchor")
    wanted = space.save(marks.groupBy("key").agg(F.collect_list(F.struct("place", "anchor")).alias("marks")), "wanted")
    space.drop("marks", "several")
    n_wanted = row_count(wanted)
    if n_wanted and n_wanted <= BROADCAST_KEYS:
        one = one.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    cut = one.join(wanted, "key").mapInArrow(_pieces(length, ANCHOR), "key binary, place long, anchor long, kind binary, centre int, piece binary")
    pieces = space.save(cut, "pieces")
    kinds = pieces.groupBy("anchor", "kind").agg(F.first("centre").alias("centre"), F.first("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
    kinds = space.save(kinds, "kinds")
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("anchor")
    many, seen = space.counted(many, "many", F.count(F.lit(1)).alias("n"))
    build = _build(length, ANCHOR, f"{space.path}/columns")
    schema = "anchor long, kind binary, runs array<struct<s:long,e:long>>"
    together = lambda of: of.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(build, schema)
    if seen["n"]:
        crowded = kinds.join(many, "anchor", "left_semi").mapInArrow(_split(length, ANCHOR), "anchor long, kind binary, copies long, group long, part binary, centre int, piece binary")
        crowded = space.save(crowded, "crowded")
        parts = crowded.groupBy("group", "part").agg(F.first("centre").alias("centre"), F.first("piece").alias("piece"), F.sum("copies").alias("copies"))
        parts = space.save(parts.select(F.monotonically_increasing_id().alias("row"), F.col("group").alias("anchor"), F.col("part").alias("kind"), "centre", "piece", "copies"), "parts")
        dense = parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("anchor")
        dense, thick = space.counted(dense, "dense", F.count(F.lit(1)).alias("n"))
        if thick["n"]:
            starts = parts.join(dense, "anchor", "left_semi").select("row", "copies", "centre", "piece").mapInArrow(_starts(length, ANCHOR), "row long, copies long, before int, digest binary")
            starts = space.save(starts, "starts")
            twice = space.save(starts.groupBy("digest").agg(F.sum("copies").alias("n")).filter("n > 1").select("digest"), "twice")
            at = starts.join(twice, "digest").groupBy("row").agg(F.collect_set(F.col("before").cast("long")).alias("at"))
            at = parts.select("row", "anchor", "kind").join(at, "row").select("anchor", "kind", F.transform("at", lambda b: F.struct(b.alias("s"), b.alias("e"))).alias("runs"))
            parts = together(parts.join(dense, "anchor", "left_anti").drop("row")).unionByName(at)
        else:
            parts = together(parts.drop("row"))
        ends = parts.select(F.col("anchor").alias("group"), F.col("kind").alias("part"), "runs")
        split = crowded.select("anchor", "kind", "group", "part").join(space.save(ends, "ends"), ["group", "part"]).select("anchor", "kind", "runs")
        # A piece has several rows, one for each range or start that it shares.
        found = together(kinds.join(many, "anchor", "left_anti")).unionByName(split)
    else:
        found = together(kinds)
    found = space.save(found, "found")
    starts = F.transform("runs", lambda r: F.struct((F.col("place") - r["e"]).alias("s"), (F.col("place") - r["s"]).alias("e")))
    placed = pieces.select("key", "place", "anchor", "kind").join(found, ["anchor", "kind"]).select("key", starts.alias("runs"))
    runs = space.save(placed.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    n_runs = row_count(runs)
    space.drop("wanted", "pieces", "kinds", "many", "crowded", "parts", "dense", "starts", "twice", "ends", "found", "columns")
    out = keyed.join(_held(copies.select("key", "copies"), n_copies, "key"), "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    if n_runs <= BROADCAST_KEYS:
        # Only texts that lose something meet their runs; the others stay where they are.
        keys = F.broadcast(runs.select("key"))
        whole = out.join(keys, "key", "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
        out = out.join(keys, "key", "left_semi").join(runs, "key").unionByName(whole)
    else:
        out = out.join(runs, "key", "left")
    return out.select("doc_id", "text", "copies", "runs").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _held(df: DataFrame, n: int, key: str) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df
