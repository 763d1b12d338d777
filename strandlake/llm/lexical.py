"""Ranked lexical search: an inverted index in document shards, and WAND in each of them.

``build_index`` turns the documents of a task into shards of bounded size. A
shard has its documents in the order of their ids and, for every term, the
documents and how often each holds it. ``search`` joins the terms of the
queries with the index, so only their lists are read on, and runs every query
on every shard: a pivot is the first document at which the maximum impacts of
the terms, taken in the order of their next documents, can reach the heap's
threshold. Cursors leap to it, and from there a window of documents is looked
at: those whose own terms' maxima stay below the threshold are skipped, the
others are scored and go to the heap. A task keeps one heap for each query
over all of its shards, and one exchange by query merges the tasks' heaps.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches

#: Documents and postings of a shard at most (places of documents take 16 bits; a longer document is a shard by itself).
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1_500_000
#: Letters of queries in one block, documents of the first window and of the largest.
BLOCK, WINDOW, WIDEST = 1 << 20, 256, 1 << 14
#: Fixed values of the score: 1000 * ln(...) as weight, saturation and length normalisation in whole numbers.
SCALE, TIMES, BASE = 1000, 1_000_000_000, 50
_GAPS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Separators become spaces and A-Z lower case; all other bytes stay.
FOLD = bytes(0x20 if b in set(_GAPS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
NO_ID = np.iinfo(np.int64).max
_INDEX = "kind int, shard long, n_docs long, n_terms long, ids binary, lengths binary, term string, df long, places binary, times binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order; null has none."""
    return (text or "").encode().translate(FOLD).split()


class Shard:
    """Documents of a task, collected until they make up one shard of the index."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.held: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        seen = Counter(terms_of(text))
        self.ids.append(doc_id)
        self.lengths.append(seen.total())
        self.held.append(np.fromiter(map(self.numbers.__getitem__, seen), np.int64, len(seen)))
        self.times.append(np.fromiter(seen.values(), np.int64, len(seen)))
        self.postings += len(seen)

    def rows(self, name: int, schema: pa.Schema):
        """The shard's own row and the rows of its terms; places follow the ids (null ids last, equal ids as they came)."""
        null = np.array([i is None for i in self.ids], bool)
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        lengths = np.array(self.lengths, np.int64)[order]
        yield _batch(schema, kind=[0], shard=[name], n_docs=[int((lengths > 0).sum())], n_terms=[int(lengths.sum())], ids=[ids[order].tobytes() + np.packbits(null[order]).tobytes()], lengths=[lengths.tobytes()])
        terms, times = np.concatenate(self.held), np.concatenate(self.times)
        key = terms << 16 | np.repeat(place, [len(x) for x in self.held])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        edges = np.searchsorted(key, np.arange(len(self.numbers) + 1) << 16)
        names = [t.decode() for t in self.numbers]
        most = np.maximum.reduceat(times, edges[:-1]) if len(key) else np.zeros(0, np.int64)
        for wide in (False, True):  # multiplicities take one byte where they can
            own = np.flatnonzero((most > 255) == wide)
            for s in range(0, len(own), 20_000):
                part = own[s : s + 20_000]
                n = edges[part + 1] - edges[part]
                at = np.arange(int(n.sum())) + np.repeat(edges[part] - (np.cumsum(n) - n), n)
                offsets = np.append(0, np.cumsum(n))
                lists = (_binary(offsets, (key[at] & 0xFFFF).astype(np.uint16)), _binary(offsets, times[at].astype(np.uint32 if wide else np.uint8)))
                yield _batch(schema, kind=np.ones(len(part), np.int32), shard=np.full(len(part), name), term=[names[i] for i in part], df=n, places=lists[0], times=lists[1])


def _binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def _index(most_docs: int, most_postings: int):
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("shard", "n_docs", "n_terms")), ("ids", pa.binary()), ("lengths", pa.binary()), ("term", pa.string()), ("df", pa.int64()), ("places", pa.binary()), ("times", pa.binary())])

    def run(batches):
        name, shard = TaskContext.get().partitionId() << 24, Shard()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for s in range(0, len(ids), 512):
                for doc_id, text in zip(ids.slice(s, 512).to_pylist(), texts.slice(s, 512).to_pylist()):
                    shard.add(doc_id, text)
                    if len(shard.ids) >= most_docs or shard.postings >= most_postings:
                        yield from shard.rows(name, schema)
                        name, shard = name + 1, Shard()
        if shard.ids:
            yield from shard.rows(name, schema)

    return run


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of all rows of ``docs`` (doc_id, text), as rows of shards (kind 0) and of their terms (kind 1).

    Nothing is shuffled: a shard holds documents of one task. Texts are taken
    whole; one of any length fits in a shard. The terms' order is fixed by the
    documents', so a lost task gives the same rows again.
    """
    if not 0 < shard_docs <= SHARD_DOCS:
        raise ValueError(f"a shard holds 1 to {SHARD_DOCS} documents")
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_index(shard_docs, shard_postings), _INDEX)


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heap:
    """The k best (score, id) so far: highest scores, then smallest ids; null ids come last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores = self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def push(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]
        if len(best) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def wand(lists: list[tuple[int, np.ndarray, np.ndarray]], ids: np.ndarray, null: np.ndarray, heap: Heap, widest: int = WIDEST) -> int:
    """Takes a shard's documents into the heap; returns how many were scored.

    ``lists``: of every term its maximum impact, places in ascending order and
    their impacts. A document that only ties with the threshold is scored, so
    ties go to the smaller id whatever the order of shards.
    """
    if not lists:
        return 0
    most = np.array([m for m, _, _ in lists], np.int64)
    sizes = np.array([len(p) for _, p, _ in lists], np.int64)
    slot = np.arange(len(lists)) << 17
    keys = np.concatenate([p for _, p, _ in lists]) + np.repeat(slot, sizes)
    impacts = np.concatenate([x for _, _, x in lists])
    end = np.cumsum(sizes)
    cursor, width, scored = end - sizes, WINDOW, 0
    while True:
        live = np.flatnonzero(cursor < end)
        next_ = keys[cursor[live]] - slot[live]
        order = np.argsort(next_, kind="stable")
        reach = np.cumsum(most[live[order]])
        at = int(np.searchsorted(reach, heap.floor))
        if at == len(live):  # all that is left together stays below the threshold
            return scored
        pivot = int(next_[order[at]])
        first = np.maximum(cursor, np.searchsorted(keys, slot + pivot))
        cursor = np.searchsorted(keys, slot + min(pivot + width, 1 << 16))
        n = cursor - first
        term = np.repeat(np.arange(len(lists)), n)
        got = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        doc = keys[got] - slot[term] - pivot
        open_ = np.bincount(doc, most[term], minlength=1) >= heap.floor
        got = got[open_[doc]]
        doc = doc[open_[doc]]
        found = np.zeros(len(open_), np.int64)
        np.add.at(found, doc, impacts[got])
        scored += int(open_.sum())
        there = np.flatnonzero(open_ & (found >= heap.floor))
        if len(there):
            heap.push(found[there], ids[there + pivot], null[there + pivot])
        width = min(4 * width, widest)


def _searcher(n_docs: int, total: int, k: int):
    def run(batches):
        block, heaps, queries, names = None, {}, [], []
        shard, held = None, {}

        def finish():
            ids, null, lengths = held.pop("")
            norm = 100 - BASE + (BASE * lengths * n_docs) // total
            lists = {}
            for term, (places, times) in held.items():
                impact = (TIMES * times) // (1000 * times + 20 * norm[places])
                lists[term] = (int(impact.max()), places, impact)
            for q in queries:
                own = [(w * lists[t][0], lists[t][1], w * lists[t][2]) for t, w in q[1] if t in lists and w > 0]
                if own:
                    wand(own, ids, null, heaps[q[0]])

        def out():
            for q, _ in queries:
                h = heaps[q]
                if len(h.scores):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h.scores), q)), pa.array([names[q]] * len(h.scores), pa.int64()), pa.array(h.ids, mask=h.null), pa.array(h.scores)], ["query", "item_id", "doc_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if shard is not None and (r["block"], r["shard"]) != (block, shard):
                    finish()
                    shard = None
                if r["block"] != block:
                    yield from out()
                    block, heaps = r["block"], {}
                shard = r["shard"]
                if r["kind"] == 0:
                    if not heaps:
                        queries = [(q["query"], [(t["term"], weight(n_docs, t["df"])) for t in q["terms"]]) for q in r["queries"]]
                        names = {q["query"]: q["item_id"] for q in r["queries"]}
                        heaps = {q: Heap(k) for q, _ in queries}
                    held = {}
                elif r["kind"] == 1:
                    lengths = np.frombuffer(r["times"], np.int64)
                    ids = np.frombuffer(r["places"], np.int64, len(lengths))
                    held[""] = (ids, np.unpackbits(np.frombuffer(r["places"], np.uint8, offset=8 * len(lengths)), count=len(lengths)).astype(bool), lengths)
                else:
                    n = len(r["places"]) // 2
                    held[r["term"]] = (np.frombuffer(r["places"], np.uint16).astype(np.int64), np.frombuffer(r["times"], f"u{len(r['times']) // n}").astype(np.int64))
        if shard is not None:
            finish()
        yield from out()

    return run


def _query_terms(batches):
    """(query, item_id, terms, size): the distinct terms of every query; rows get numbers of their own."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        terms = [sorted({t.decode() for t in terms_of(x)}) for x in batch.column("text").to_pylist()]
        ids = batch.column("item_id")
        yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(terms)), pa.int64()), ids.cast(pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array([sum(map(len, x)) + 64 for x in terms], pa.int64())], ["query", "item_id", "terms", "size"])
        number += len(terms)


def search(index: DataFrame, queries: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every row of ``queries`` (item_id, text).

    ``index`` is a written table (it is read more than once). Queries go in
    blocks of about ``block`` letters; a block is one row, dealt to every
    shard. Equal scores go to the smaller doc_id, null ids last. Queries
    without terms, or whose terms no document holds, have no rows; queries
    that repeat an item_id each have their own. Documents that repeat an id
    are ranked each by itself. A term that most documents hold may weigh 0 or
    less and then adds nothing.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "lexical")
    asked, seen = space.counted(queries.select("item_id", "text").mapInArrow(_query_terms, "query long, item_id long, terms array<string>, size long"), "queries", F.sum("size").alias("size"))
    n_blocks = -(-(seen["size"] or 0) // block) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = index.filter("kind = 0")
    totals = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    each = asked.select("query", "block", F.explode("terms").alias("term"))
    wanted = space.save(each.select("block", "term").distinct(), "terms")
    found = space.save(index.filter("kind = 1").select("shard", "term", "df", "places", "times").join(wanted, "term"), "lists")
    known = found.groupBy("block", "term").agg(F.sum("df").alias("df"))
    weighed = each.join(known, ["block", "term"]).groupBy("block", "query").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    # A block's queries have a bounded size.
    packed = weighed.join(asked.select("query", "item_id"), "query").groupBy("block").agg(F.collect_list(F.struct("query", "item_id", "terms")).alias("queries"))
    packed = space.save(packed, "blocks")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    own = shards.select("shard", every, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("term"), F.col("ids").alias("places"), F.col("lengths").alias("times"))
    lists = found.select("shard", "block", F.lit(2).alias("kind"), "term", "places", "times")
    none = F.lit(None)
    asking = own.select("shard", "block").join(packed, "block").select("shard", "block", F.lit(0).alias("kind"), none.cast("string").alias("term"), none.cast("binary").alias("places"), none.cast("binary").alias("times"), "queries")
    stream = asking.unionByName(own.unionByName(lists).join(packed.select("block"), "block", "left_semi"), allowMissingColumns=True)
    place = F.pmod(F.shiftright("shard", 24) + F.col("shard").bitwiseAND(F.lit((1 << 24) - 1)) + F.col("block"), F.lit(parts)).cast("int")
    dealt = stream.repartitionById(parts, place).sortWithinPartitions("block", "shard", "kind")
    heaps = dealt.mapInArrow(_searcher(totals["n"] or 0, totals["l"] or 1, k), "query long, item_id long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return heaps.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """``search`` over a fresh index of ``docs``, written to the shared folder. An empty table gives an empty result."""
    space = Workspace(docs.sparkSession, "lexical-index")
    return search(space.save(build_index(docs), "index"), queries, k)
