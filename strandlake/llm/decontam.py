"""Benchmark decontamination with sparse suffix arrays over the training text.

Each block of documents gets a word-level suffix array. It holds the suffixes
that can match at all: those that begin with the first two words of some
benchmark suffix. Suffixes are ordered by their first ``window`` words through
prefix doubling; then every benchmark suffix is binary-searched in it, which
gives all places of the matching windows. A document's longest verbatim match
is found from its own side: places are followed through the benchmark's grams
of 1, 2, ... words, and windows that match one after the other are one match.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONALNUM, bounded_batches, chunks, unused, word_hashes, word_places

WINDOW = 10
#: Bytes of benchmark text that one block of items may have when it is broadcast.
BLOCK_BYTES = 8 << 20


class Probes:
    """The suffixes of one block of benchmark items, as rows of up to ``window`` word numbers.

    A suffix is searched if a whole window starts there; an item of fewer
    words than the window is one probe of its own length.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        whole, first, last, offsets = word_places([t for _, t in items], NONALNUM)
        hashes = word_hashes(np.frombuffer(whole, np.uint8), first, last)
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        self.items, rows, self.length, follows = [], [], [], []
        #: The words of every probe in bytes, for the comparison that confirms a hit.
        self.words: list[list[bytes]] = []
        for i, (name, _) in enumerate(items):
            words = numbers[offsets[i] : offsets[i + 1]]
            n = min(window, len(words))
            for start in range(len(words) - n + 1 if n else 0):
                row = np.zeros(window, np.int64)
                row[:n] = words[start : start + n]
                rows.append(row)
                self.length.append(n)
                self.items.append(name)
                self.words.append([whole[first[k] : last[k]] for k in range(offsets[i] + start, offsets[i] + start + n)])
                follows.append(start > 0)
        self.rows = np.array(rows, np.int64).reshape(-1, window)
        self.length = np.array(self.length, np.int64)
        full = self.rows[self.length > 1]
        self.pairs = np.unique(full[:, 0] * (len(self.vocabulary) + 1) + full[:, 1])
        self.single = np.unique(self.rows[self.length == 1, 0])
        #: Whether a probe begins one word after the probe before it, in the same item.
        self.follows = np.array(follows, bool)
        # Sorted keys of the items' grams of 2, 3, ... words, from (the number of the gram without its last word, that word).
        base = len(self.vocabulary) + 1
        padded = np.zeros(len(numbers) + len(items) * window, np.int64)
        padded[np.arange(len(numbers)) + np.repeat(np.arange(len(items)), np.diff(offsets)) * window] = numbers
        at, gram = np.flatnonzero(padded), padded[padded > 0]
        self.grams = []
        for k in range(1, window):
            next_ = padded[np.minimum(at + k, len(padded) - 1)]
            next_[at + k >= len(padded)] = 0
            at, key = at[next_ > 0], (gram * base + next_)[next_ > 0]
            grams, gram = np.unique(key, return_inverse=True)
            self.grams.append(grams)


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the ``depth`` words from there, by prefix doubling.

    ``words`` ends with ``depth`` zeros, which sort before every word.
    """
    if not len(starts):
        return starts
    rank, held = words.astype(np.int64), 1
    while held < depth:
        ahead = np.concatenate((rank[held:], np.zeros(held, np.int64)))
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        if 2 * held >= depth:
            return starts[np.argsort(key[starts], kind="stable")]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        held *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(words: np.ndarray, order: np.ndarray, probes: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For every probe at once: how many suffixes of ``order`` sort before it (or not after it)."""
    low, high = np.zeros(len(probes), np.int64), np.full(len(probes), len(order), np.int64)
    column = np.arange(probes.shape[1])
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        there = words[at[:, None] + column]
        differ = (there != probes) & (column < length[:, None])
        first = np.where(differ.any(1), differ.argmax(1), 0)
        row = np.arange(len(probes))
        less, equal = there[row, first] < probes[row, first], ~differ.any(1)
        right = open_ & (less | (equal & upper))
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def longest(words: np.ndarray, begin: np.ndarray, probes: Probes) -> np.ndarray:
    """Words of the longest match of every document, up to the window. ``words`` ends with a window of zeros."""
    base, most = len(probes.vocabulary) + 1, np.zeros(len(begin), np.int64)
    at = np.flatnonzero(words)
    gram = words[at]
    for k in range(1, probes.window + 1):
        most[np.searchsorted(begin, at, "right") - 1] = k
        if k == probes.window or not len(at) or not len(probes.grams[k - 1]):
            break
        key, grams = gram * base + words[at + k], probes.grams[k - 1]
        gram = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        same = (grams[gram] == key) & (words[at + k] > 0)
        at, gram = at[same], gram[same]
    return most


def runs(found: list[tuple[int, int]], probes: Probes) -> Iterator[tuple[int, int]]:
    """(first place, words) of the matches that (probe, place) pairs make up: whole windows one word apart are one match."""
    held: dict[tuple[int, int], int] = {}
    for p, s in sorted(found):
        before = held.pop((p - 1, s - 1), None) if probes.follows[p] else None
        held[p, s] = s if before is None else before
    for (p, s), first in held.items():
        yield first, s - first + int(probes.length[p])


def scan(texts: list[bytes], probes: Probes) -> Iterator[tuple[int, list[tuple[int, int]], list[str], int]]:
    """For every text: number of words, hit word spans, items that occur whole windows of, words of the longest match."""
    base, w = len(probes.vocabulary) + 1, probes.window
    for a, b in chunks(texts):
        whole, first, last, offsets = word_places(texts[a:b], NONALNUM)
        hashes = word_hashes(np.frombuffer(whole, np.uint8), first, last)
        at = np.searchsorted(probes.vocabulary, hashes)
        known = at < len(probes.vocabulary)
        known[known] = probes.vocabulary[at[known]] == hashes[known]
        # Documents stand apart by a word that no probe has, and zeros end the array.
        number = np.where(known, at + 1, 0)
        gap = np.repeat(np.arange(b - a), np.diff(offsets)) * w
        words = np.zeros(len(hashes) + (b - a + 1) * w, np.int64)
        place = np.arange(len(hashes)) + gap
        words[place] = number
        key = words[:-1] * base + words[1:]
        candidate = np.isin(key, probes.pairs) & (words[:-1] > 0)
        if len(probes.single):
            candidate |= np.isin(words[:-1], probes.single)
        order = suffix_array(words, np.flatnonzero(candidate), w) if candidate.any() else np.zeros(0, np.int64)
        begin = offsets[:-1] + np.arange(b - a) * w
        spans: list[list] = [[] for _ in range(b - a)]
        items: list[set] = [set() for _ in range(b - a)]
        most = longest(words, begin, probes)
        if len(order) and len(probes.rows):
            low = _bound(words, order, probes.rows, probes.length, False)
            high = _bound(words, order, probes.rows, probes.length, True)
            found = []
            for p in np.flatnonzero(high > low).tolist():
                for s in order[low[p] : high[p]].tolist():
                    d, n = int(np.searchsorted(begin, s, "right")) - 1, int(probes.length[p])
                    at = s - d * w
                    if [whole[first[k] : last[k]] for k in range(at, at + n)] == probes.words[p]:
                        found.append((p, s))
                        spans[d].append((int(s - begin[d]), int(s - begin[d]) + n))
                        items[d].add(probes.items[p])
            for start, n in runs(found, probes):
                d = int(np.searchsorted(begin, start, "right")) - 1
                most[d] = max(most[d], n)
        for d in range(b - a):
            yield int(offsets[d + 1] - offsets[d]), merged(spans[d]), sorted(items[d]), int(most[d])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word spans, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items with words, in blocks of bounded size."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).filter("item is not null and text is not null").toLocalIterator():
        text = row["text"].encode()
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append((row["item"], text))
        held += len(text)
    yield block


#: The probes of the blocks that this worker process met last; they are built once, not in every task.
_BUILT: dict[str, Probes] = {}
#: How many of them it keeps.
KEPT = 4
_SCHEMA = "n_words long, spans array<struct<s:long,e:long>>, items array<string>, longest long"


def _scanner(held, window: int):
    name = uuid.uuid4().hex

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        probes = _BUILT.pop(name, None) or Probes(held.value, window)
        _BUILT[name] = probes
        while len(_BUILT) > KEPT:
            del _BUILT[next(iter(_BUILT))]
        for texts in frames:
            found = list(scan([t.encode() if isinstance(t, str) else b"" for t in texts], probes))
            yield pd.DataFrame({"n_words": [x[0] for x in found], "spans": [[{"s": s, "e": e} for s, e in x[1]] for x in found], "items": [x[2] for x in found], "longest": [x[3] for x in found]})

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "hit") -> DataFrame:
    """Every row of ``docs`` with a struct ``into``: n_words, spans (runs of hit words), items, longest.

    A document without words, or null, has no spans. Items without words or
    id match nothing; an empty benchmark hits nothing. Each block of items is a
    broadcast of ``block_bytes`` at most and one more scan expression on the same
    row, so nothing is shuffled; a benchmark that is itself larger than a
    worker's memory must be given in parts. ``into`` must not be a column of
    ``docs``.
    """
    if unused(into, docs) != into:
        raise ValueError(f"the column name {into} is taken")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = []
    for k, block in enumerate(item_blocks(benchmark, block_bytes)):
        name = unused(f"{into}_{k}", docs)
        docs = docs.withColumn(name, F.pandas_udf(_scanner(spark.sparkContext.broadcast(block), window), _SCHEMA)("text"))
        parts.append(name)
    if len(parts) == 1:
        return docs.withColumnRenamed(parts[0], into)
    spans = F.array_sort(F.flatten(F.array(*(F.col(f"{p}.spans") for p in parts))))
    joined = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<s:long,e:long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    hit = F.struct(
        F.col(f"{parts[0]}.n_words").alias("n_words"),
        joined.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"{p}.items") for p in parts))))).alias("items"),
        F.greatest(*(F.col(f"{p}.longest") for p in parts)).alias("longest"),
    )
    return docs.withColumn(into, hit).drop(*parts)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and longest match of every document.

    Rows stay one to one: repeated rows and null ids are reported as they are.
    """
    found = overlaps(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        (F.size("hit.spans") > 0).alias("contaminated"),
        F.col("hit.longest").alias("longest_match"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their columns, whatever the names of these.

    Null and empty texts stay, and so do null ids; rows that repeat stay or go
    alike. An empty benchmark takes nothing away, an empty table stays empty.
    """
    hit = unused("hit", docs)
    return overlaps(docs, benchmark, window, into=hit).filter(F.size(F.col(f"{hit}.spans")) == 0).drop(hit)
