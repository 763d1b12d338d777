"""Cross-tokenizer alignment: how often tokens of two vocabularies cover the same bytes, corpus-wide, and what that says of each document.

Both tokenizers cut the same bytes (a space and the text). Stretches between
common ends are groups; a pair of tokens that share bytes is a link. What a
document's links count corpus-wide comes from a cogroup of postings:

* A task tokenises its documents and turns a stretch of them (a *flush*) into
  postings (side-B id, side-A id, document, multiplicity), sorted, in one block
  for each bucket of side-B ids, with the pairs' partial counts beside them.
* The partial counts of a bucket are merged. Then they and the postings are
  shuffled by bucket and share of flushes: a side id that holds much of the
  corpus makes its bucket large, and a large bucket is dealt to as many tasks
  as it needs, each with the bucket's counts. Spark's sort spills; a task reads
  its stream once, counts first, and holds one bucket's counts and one block.
* Counts and each side id's maximum are computed there, every block gives its
  documents' contributions, and these are summed by document.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches

#: Where the public vocabulary files are, by default, and their names.
TOKENIZERS, BYTE_BPE, PIECE_BPE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: the pattern by which a byte-level vocabulary of this kind splits text before its merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets of side-B ids (a power of two), links of a flush, units that a worker remembers, and letters of these.
BUCKETS, FLUSH, UNITS, MEMORY = 64, 3_000_000, 300_000, 8 << 20
#: Partial counts of a bucket that one task merges at a time.
FAN_IN = 512
#: Both vocabularies begin a token at a space after such a character; of others one might be white space too.
SAFE = re.compile(r"[\w!-~]").match
_DOCS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_TABLE = f"kind int, flush long, bucket int, n long, data binary, slot int, doc_id long, {_DOCS}"


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable Latin-1 for itself, letters from U+0100 on for the rest."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}


class Known(dict):
    """Numbers of units. One that is new is noted; one that is empty or ends oddly is -1."""

    def __init__(self):
        self.fresh: list[str] = []
        self.taken = 0

    def __missing__(self, unit: str) -> int:
        if not unit or not SAFE(unit[-1]):
            n = -1
        else:
            n, self.taken = self.taken, self.taken + 1
            self.fresh.append(unit)
        self[unit] = n
        return n


class Units:
    """Alignments of text units, a unit being a space and what follows it up to the next; each is computed once.

    ``number`` gives units' numbers. Of unit u: ``n_a``, ``n_b``, ``n_groups``,
    links ``first[u]`` to ``first[u + 1]`` of ``pairs`` (B id << 16 | A id), its
    groups as ``groups[u]``; ``good[u]`` is false where a side's bytes differ.
    """

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        held = json.loads(byte_bpe)
        special = {x["content"] for x in held["added_tokens"] if x["special"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in k): v for k, v in held["model"]["vocab"].items() if k not in special}
        self.a = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_a[v] = k
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) > 1 << 16 or len(self.bytes_b) > 1 << 15:
            raise ValueError("ids of side A take 16 bits, of side B 15")
        # Splitting at spaces is exact only where no piece goes on after a space that follows something else.
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text = [b"%d" % i + end for end in (b",", b"|", b",", b";") for i in range(1 << 16)]
        self.long_text = np.array([len(x) for x in self.text], np.int64)
        self.clear()

    def clear(self) -> None:
        self.known, self.size = Known(), 0
        self.n_a = self.n_b = self.n_groups = np.zeros(0, np.int64)
        self.good, self.first, self.pairs = np.zeros(0, bool), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def number(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of every text's units; new ones are aligned. A text with other spaces than single ones between words is one unit."""
        known, out, whole = self.known, [], []
        for text in texts:
            units = text.split(" ") if text and self.splits else []
            found = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            if text and (not len(found) or found.min() < 0):
                whole.append((len(out), text))
            out.append(found)
        fresh, known.fresh = known.fresh, []
        if fresh:
            a = self.a.encode_to_numpy(" " + " ".join(fresh), disallowed_special=()).astype(np.int64)
            source = [f" {u}".encode() for u in fresh]
            ends = np.cumsum([len(x) for x in source])
            stop = np.searchsorted(np.cumsum(self.long_a[a]), ends, "right")
            self.align(source, a, np.diff(stop, prepend=0), self.b.encode(fresh, num_threads=1))
        for i, text in whole:
            a = self.a.encode_to_numpy(f" {text}", disallowed_special=()).astype(np.int64)
            out[i] = np.array([known.taken])
            known.taken += 1
            self.align([f" {text}".encode()], a, np.array([len(a)]), [self.b.encode(text)])
        return out

    def align(self, source: list[bytes], flat_a: np.ndarray, n_a: np.ndarray, b: list[list[int]]) -> None:
        n_b = np.array([len(x) for x in b], np.int64)
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        good, long, joined = np.ones(len(source), bool), np.array([len(s) for s in source], np.int64), b"".join(source)
        edges = [np.concatenate(([0], np.cumsum(t[f])))[np.cumsum(n)] for t, f, n in ((self.long_a, flat_a, n_a), (self.long_b, flat_b, n_b))]
        if any(b"".join(map(t.__getitem__, f.tolist())) != joined for t, f in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))) or any((e != np.cumsum(long)).any() for e in edges):
            a_of = np.split(flat_a, np.cumsum(n_a)[:-1])
            for i, s in enumerate(source):
                good[i] = b"".join(self.bytes_a[x] for x in a_of[i].tolist()) == s == b"".join(self.bytes_b[x] for x in b[i])
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
            n_a, n_b, long = n_a * good, n_b * good, long * good
        end_a, end_b = np.cumsum(self.long_a[flat_a]), np.cumsum(self.long_b[flat_b])
        flags = np.zeros(int(long.sum()) + 1, np.uint8)
        flags[end_a] |= 1
        flags[end_b] |= 2
        at = np.flatnonzero(flags)
        mark = flags[at]
        in_a, in_b, both = (mark & 1).astype(np.int64), (mark >> 1).astype(np.int64), mark == 3
        pairs = flat_b[np.cumsum(in_b) - in_b] << 16 | flat_a[np.cumsum(in_a) - in_a]
        last = np.searchsorted(at, np.cumsum(long), "right")
        total = np.concatenate(([0], np.cumsum(both)))
        n_groups = np.diff(total[last], prepend=0)
        # Groups in writing: A ids of a group, then B ids, each with the sign that follows it.
        whole_a, whole_b = flags[end_a] == 3, flags[end_b] == 3
        group_a, group_b = np.cumsum(whole_a) - whole_a, np.cumsum(whole_b) - whole_b
        each = np.arange(int(total[-1]) + 1)
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[np.arange(len(flat_a)) + np.searchsorted(group_b, each)[group_a]] = flat_a + (whole_a << 16)
        codes[np.arange(len(flat_b)) + np.searchsorted(group_a, each)[group_b + 1]] = flat_b + (whole_b << 16) + (2 << 16)
        text = b"".join(map(self.text.__getitem__, codes.tolist()))
        stop = np.concatenate(([0], np.cumsum(self.long_text[codes])))[np.cumsum(n_a + n_b)].tolist()
        self.groups += [text[s:e] for s, e in zip([0, *stop], stop)]
        self.n_a, self.n_b, self.n_groups = np.append(self.n_a, n_a), np.append(self.n_b, n_b), np.append(self.n_groups, n_groups)
        self.good = np.append(self.good, good)
        self.first = np.append(self.first, self.first[-1] + last)
        self.pairs = np.append(self.pairs, pairs)
        self.size += len(joined)


def bucket_of(b: np.ndarray) -> np.ndarray:
    """Neighbouring ids go to unlike buckets: the leading bits of a product with the golden ratio's fraction."""
    return (b * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - BUCKETS.bit_length() + 1


def pack(pairs: np.ndarray, lengths: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """A block of postings: pairs, how many documents each has, these, their multiplicities, in as few bytes as they need."""
    d, t = (x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (docs, times))
    head = np.array([len(pairs), len(docs), d.itemsize, t.itemsize], np.uint32)
    return b"".join((head.tobytes(), pairs.astype(np.uint32).tobytes(), lengths.astype(np.uint32).tobytes(), d.tobytes(), t.tobytes()))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pairs, posts, d, t = np.frombuffer(data, np.uint32, 4).tolist()
    at = 16 + 8 * pairs
    return (
        np.frombuffer(data, np.uint32, pairs, 16).astype(np.int64),
        np.frombuffer(data, np.uint32, pairs, 16 + 4 * pairs).astype(np.int64),
        np.frombuffer(data, f"u{d}", posts, at).astype(np.int64),
        np.frombuffer(data, f"u{t}", posts, at + d * posts).astype(np.int64),
    )


def pack_counts(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return pairs.astype(np.uint32).tobytes() + counts.astype(np.int64).tobytes()


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint32, n).astype(np.int64), np.frombuffer(data, np.int64, n, 4 * n)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def blocks(docs: list[np.ndarray], units: Units) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, postings, partial counts) of a flush's documents, given as unit numbers (none where they have no tokens)."""
    held = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    n = units.first[held + 1] - units.first[held]
    at = np.arange(int(n.sum())) + np.repeat(units.first[held] - (np.cumsum(n) - n), n)
    pairs = units.pairs[at]
    doc = np.repeat(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), n)
    key = bucket_of(pairs >> 16) << 56 | pairs << 24 | doc
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    bucket, pairs, doc = key >> 56, key >> 24 & 0xFFFFFFFF, key & 0xFFFFFF
    edge = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    for k in range(BUCKETS):
        s = slice(edge[k], edge[k + 1])
        if s.start == s.stop:
            continue
        begin = np.flatnonzero(np.diff(pairs[s], prepend=-1))
        lengths = np.diff(np.append(begin, s.stop - s.start))
        yield k, pack(pairs[s][begin], lengths, doc[s], times[s]), pack_counts(pairs[s][begin], np.add.reduceat(times[s], begin))


#: The units of the vocabularies that this worker used last, and a sign of these.
_HELD: list = [None, None]


def units_of(byte_bpe: bytes, piece_bpe: bytes) -> Units:
    sign = zlib.crc32(piece_bpe, zlib.crc32(byte_bpe)), len(byte_bpe), len(piece_bpe)
    if _HELD[0] != sign:
        _HELD[:] = sign, Units(byte_bpe, piece_bpe)
    return _HELD[1]


def _tokenise(byte_bpe, piece_bpe, flush_links: int, most_units: int):
    schema = pa.schema([("kind", pa.int32()), ("flush", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("slot", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        units = units_of(byte_bpe.value, piece_bpe.value)
        flush = TaskContext.get().partitionId() << 24
        docs: list[np.ndarray] = []
        links = 0

        def flushed():
            for k, posts, counts in blocks(docs, units):
                yield table(kind=[1, 2], flush=[flush] * 2, bucket=[k] * 2, n=[len(counts), len(posts)], data=[counts, posts])

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for start in range(0, len(texts), 256):
                part = [t or "" for t in texts.slice(start, 256).to_pylist()]
                numbers = units.number(part)
                numbers = [u if units.good[u].all() else u[:0] for u in numbers]
                shas = []
                for u in numbers:
                    h = hashlib.sha256(b"".join(map(units.groups.__getitem__, u.tolist()))[:-1]) if len(u) else None
                    shas.append(h.hexdigest() if h else "")
                n_links = [int((units.first[u + 1] - units.first[u]).sum()) for u in numbers]
                sums = {c: [int(x[u].sum()) for u in numbers] for c, x in (("n_a", units.n_a), ("n_b", units.n_b), ("n_groups", units.n_groups))}
                slots = range(len(docs), len(docs) + len(part))
                yield table(kind=[0] * len(part), flush=[flush] * len(part), slot=list(slots), doc_id=ids.slice(start, 256), n_links=n_links, groups_sha256=shas, **sums)
                docs += numbers
                links += sum(n_links)
                if links >= flush_links or len(docs) >= 1 << 23:
                    yield from flushed()
                    docs, links, flush = [], 0, flush + 1
                    if units.known.taken > most_units or units.size > MEMORY:
                        units.clear()
        yield from flushed()

    return run


def _merged(most: int = 1 << 18):
    """Streams of (bucket, share, data) by bucket and share to their merged counts, in rows of bounded size."""

    def out(bucket, share, held):
        pairs, counts = merge_counts(held)
        for s in range(0, len(pairs), most):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([share], pa.int32()), pa.array([pack_counts(pairs[s : s + most], counts[s : s + most])], pa.binary())], ["bucket", "share", "data"])

    def run(batches):
        now, held, n = None, [], 0
        for batch in batches:
            for key, share, data in zip(batch.column("bucket").to_pylist(), batch.column("share").to_pylist(), batch.column("data")):
                if (key, share) != now:
                    if held:
                        yield from out(*now, held)
                    now, held, n = (key, share), [], 0
                held.append(unpack_counts(data.as_py()))
                n += len(held[-1][0])
                if n > 4 * most and n > 2 * len(held[0][0]):
                    held = [merge_counts(held)]
                    n = len(held[0][0])
        if held:
            yield from out(*now, held)

    return run


def _contribute(batches):
    """A stream of a bucket's counts and then its postings, to what each block adds to its documents."""
    now, held, pairs, counts, best = None, [], None, None, None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "share", "kind", "flush")), batch.column("data"))
        for bucket, share, kind, flush, data in rows:
            if (bucket, share) != now:
                now, held, pairs = (bucket, share), [], None
            if kind == 1:
                held.append(unpack_counts(data.as_py()))
                continue
            if pairs is None:
                pairs, counts = merge_counts(held)
                side = pairs >> 16
                first = np.flatnonzero(np.diff(side, prepend=-1))
                top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
                best, held = counts == top, []
            own, lengths, docs, times = unpack(data.as_py())
            at = np.repeat(np.searchsorted(pairs, own), lengths)
            n = int(docs.max()) + 1
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, docs, times * best[at])
            np.add.at(total, docs, times * counts[at])
            there = np.flatnonzero(total)
            packed = b"".join(np.asarray(x, np.min_scalar_type(int(x.max()))).tobytes() for x in (there, n_best[there], total[there]))
            kinds = [np.min_scalar_type(int(x.max())).itemsize for x in (there, n_best[there], total[there])]
            yield pa.RecordBatch.from_arrays([pa.array([flush], pa.int64()), pa.array([np.array([len(there), *kinds], np.uint32).tobytes() + packed], pa.binary())], ["flush", "data"])


def _summed(batches):
    """A stream of contributions by flush, to sums by document."""

    def out(flush, best, total):
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), flush)), pa.array(slots.astype(np.int32)), pa.array(best[slots]), pa.array(total[slots])], ["flush", "slot", "n_best", "count_sum"])

    now, best, total = None, None, None
    for batch in batches:
        for flush, data in zip(batch.column("flush").to_pylist(), batch.column("data").to_pylist()):
            if flush != now:
                if now is not None:
                    yield from out(now, best, total)
                now, best, total = flush, np.zeros(0, np.int64), np.zeros(0, np.int64)
            n, *kinds = np.frombuffer(data, np.uint32, 4).tolist()
            at, parts = 16, []
            for k in kinds:
                parts.append(np.frombuffer(data, f"u{k}", n, at).astype(np.int64))
                at += k * n
            if int(parts[0][-1]) >= len(best):
                best, total = (np.append(x, np.zeros(int(parts[0][-1]) + 1 - len(x), np.int64)) for x in (best, total))
            best[parts[0]] += parts[1]
            total[parts[0]] += parts[2]
    if now is not None:
        yield from out(now, best, total)


def _spread(flush: Column, parts: int) -> Column:
    """A partition for a flush: neighbouring tasks' flushes go to neighbouring partitions."""
    return F.pmod(F.shiftright(flush, 24) + flush.bitwiseAND(F.lit((1 << 24) - 1)), F.lit(parts)).cast("int")


def align(docs: DataFrame, tokenizers: str = TOKENIZERS, flush: int = FLUSH, units: int = UNITS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    Null and empty texts, and those that a vocabulary doesn't give back byte
    for byte, have no tokens: zeros and ''. Rows stay one to one: repeated rows
    count as often as they stand there, null ids are reported as they are. A
    text of any length is tokenised whole; it is one flush by itself if it has
    that many links. Side-A ids that tie for a side-B id's maximum are all best.
    Other columns play no part. An empty table gives an empty result.

    ``tokenizers``: the folder of the vocabulary files on the driver; their
    bytes (2.1 MB) are broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "alignment")
    files = [spark.sparkContext.broadcast(Path(tokenizers, x).read_bytes()) for x in (BYTE_BPE, PIECE_BPE)]
    held = space.save(docs.select("doc_id", "text").mapInArrow(_tokenise(*files, flush, units), _TABLE), "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row for each bucket: their number is fixed.
    sizes = {r["bucket"]: r for r in held.filter("kind = 2").groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("flushes")).collect()}
    share = sum(r["n"] for r in sizes.values()) / (2 * parts) + 1
    shares = [min(-(-sizes[k]["n"] // int(share)), sizes[k]["flushes"]) if k in sizes else 1 for k in range(BUCKETS)]
    before = np.cumsum([0, *shares[:-1]]).tolist()

    def of(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("bucket"))

    merged = held.filter("kind = 1").select("bucket", "flush", "data")
    most = max((r["flushes"] for r in sizes.values()), default=0)
    while most > FAN_IN:  # a tree: each round divides the number of a bucket's parts
        most = -(-most // FAN_IN)
        merged = _tree(merged, most, parts)
    merged = space.save(_tree(merged, 1, BUCKETS), "counts")
    streams = merged.select("bucket", F.explode(F.sequence(F.lit(0), of(shares) - 1)).alias("share"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("flush"), "data")
    posts = held.filter("kind = 2").select("bucket", F.pmod(F.xxhash64("flush"), of(shares)).cast("int").alias("share"), "kind", "flush", "data")
    dealt = streams.unionByName(posts).repartitionById(parts, F.pmod(of(before) + F.col("share"), F.lit(parts)).cast("int"))
    added = dealt.sortWithinPartitions("bucket", "share", "kind", "flush").mapInArrow(_contribute, "flush long, data binary")
    sums = added.repartitionById(parts, _spread(F.col("flush"), parts)).sortWithinPartitions("flush").mapInArrow(_summed, "flush long, slot int, n_best long, count_sum long")
    rows = held.filter("kind = 0").join(sums, ["flush", "slot"], "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def _tree(counts: DataFrame, shares: int, parts: int) -> DataFrame:
    """Partial counts merged into ``shares`` parts of each bucket."""
    dealt = counts.withColumn("share", F.pmod(F.xxhash64("flush"), F.lit(shares)).cast("int"))
    out = dealt.repartitionById(parts, F.pmod(F.col("bucket") + F.col("share") * BUCKETS, F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "share").select("bucket", "share", "data")
    return out.mapInArrow(_merged(), "bucket int, share int, data binary").withColumn("flush", F.col("share").cast("long")).select("bucket", "flush", "data")
