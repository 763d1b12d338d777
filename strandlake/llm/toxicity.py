"""Toxicity scores from a lexicon, misspellings of it, and the words around.

A lexicon is learned from labelled documents: words, and beginnings of words
for languages that build them, that are far likelier in toxic documents. It is
held in a trie. A Levenshtein automaton over the trie accepts every spelling
within one edit of a long enough term (two for very long ones); the product of
both is made deterministic state by state as words ask for it. Each hit looks
at a window around it: hits inside quotation marks or next to words of speech
are counted apart from plain ones, and the surrounding words have weights of
their own. A calibrated logistic model turns the counts into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches
from .logistic import Logistic

#: Labelled rows that are fitted on, terms and stems of the lexicon, words on either side of a hit, threshold of ``predicted``.
LABELLED, TERMS, STEMS, WINDOW, THRESHOLD = 6000, 600, 200, 6, 0.3
#: Letters from which a term may be missed by one and by two edits; letters that a stem may have.
ONE_EDIT, TWO_EDITS, STEM = 5, 9, (4, 8)
#: Words and states of the automaton that a worker remembers before it starts again.
REMEMBERED, STATES = 300_000, 100_000
#: Bytes of labelled texts that are fitted on at most; a text is taken whole or not at all.
SAMPLE = 64 << 20
WORD = re.compile(r"[^\W_]+(?:[0@$!*1345]+[^\W_]+)*")
QUOTES = re.compile("[\"“”«»„]")
#: Words that introduce what others said.
SPEECH = frozenset("said says quote quoted quotes wrote called called reported according term word sagte schrieb nannte dit mot dijo palabra".split())
NAMES = ("hits", "near", "stems", "weight", "density", "kinds", "quoted", "context", "largest", "length")


class Automaton:
    """The determinised product of a trie and a Levenshtein automaton.

    A state is a set of (trie node, edits so far). ``find`` gives (term, edits)
    with the fewest edits, then the first term; None if nothing is near.
    """

    def __init__(self, terms: list[str], one_edit: int = ONE_EDIT, two_edits: int = TWO_EDITS):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        #: Most edits that any term below a node still allows.
        self.allowed: list[int] = [0]
        self.edits = lambda t: 2 if len(t) >= two_edits else 1 if len(t) >= one_edit else 0
        for term in sorted(set(terms)):
            node, k = 0, self.edits(term)
            self.allowed[0] = max(self.allowed[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], k)
            self.ends[node] = term
        self.states: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.finals: list[tuple[str, int] | None] = []
        self.index: dict[tuple, int] = {}
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of node -> least edits, after skipping letters of the trie at one edit each."""
        open_ = sorted(nodes)
        while open_:
            node = open_.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and nodes.get(child, 9) > e:
                    nodes[child] = e
                    open_.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append({})
            self.sets.append(key)
            ends = [(e, self.ends[n]) for n, e in key if self.ends[n] is not None and e <= self.edits(self.ends[n])]
            self.finals.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.index[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.allowed[node] and after.get(node, 9) > e + 1:
                after[node] = e + 1  # a letter too many
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost <= self.allowed[child] and after.get(child, 9) > cost:
                    after[child] = cost
        to = self.states[state][letter] = self._state(after)
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        state = self.start
        for letter in word:
            to = self.states[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state == self.dead:
                return None
        return self.finals[state]


@dataclass
class Lexicon:
    """Weights (log-odds of toxic) of terms, stems and context words; the logistic model over the counts."""

    terms: dict[str, float]
    stems: dict[str, float]
    context: dict[str, float]
    model: Logistic | None = None
    prior: float = 0.0
    _auto: Automaton | None = field(default=None, repr=False)
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_auto": None, "_seen": {}}

    def look(self, word: str) -> tuple[int, float, str] | None:
        """(kind, weight, entry): 0 a term, 1 a misspelt one, 2 a stem."""
        found = self._seen.get(word, 0)
        if found != 0:
            return found
        if self._auto is None or len(self._auto.states) >= STATES:
            self._auto = Automaton(list(self.terms))
        near = self._auto.find(word)
        found = None if near is None else (int(near[1] > 0), self.terms[near[0]], near[0])
        if found is None or found[0] == 1:
            for n in range(min(STEM[1], len(word)), STEM[0] - 1, -1):
                if (w := self.stems.get(word[:n])) is not None:
                    found = (2, w, word[:n])
                    break
        if len(self._seen) >= REMEMBERED:
            self._seen.clear()
        self._seen[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        """The counts of one whole text, in the order of NAMES."""
        low = text.lower()
        words = WORD.findall(low)
        look, seen = self.look, self._seen
        hits = [(i, h) for i, w in enumerate(words) if (h := seen[w] if w in seen else look(w)) is not None]
        out = np.zeros(len(NAMES))
        out[9] = math.log1p(len(words))
        if not hits:
            return out
        quoted = self._quoted(low, {i for i, _ in hits}) if QUOTES.search(low) else set()
        total, context, kinds, largest = 0.0, 0.0, set(), 0.0
        counts = [0, 0, 0]
        for i, (kind, weight, entry) in hits:
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            said = i in quoted or any(w in SPEECH for w in around)
            if said:
                out[6] += 1
                continue
            counts[kind] += 1
            kinds.add(entry)
            total += weight
            largest = max(largest, weight if kind != 1 else weight / 2)
            context += sum(self.context.get(w, 0.0) for w in around) / len(around)
        plain = sum(counts)
        out[:6] = (math.log1p(counts[0]), math.log1p(counts[1]), math.log1p(counts[2]), math.log1p(max(0.0, total)), 100 * plain / len(words), math.log1p(len(kinds)))
        out[6] = math.log1p(out[6])
        out[7] = context / plain if plain else 0.0
        out[8] = largest
        return out

    def _quoted(self, low: str, hits: set[int]) -> set[int]:
        """The hits that stand between two quotation marks of one line."""
        marks = [m.start() for m in QUOTES.finditer(low)]
        inside, pairs, at = set(), [], 0
        while at + 1 < len(marks):
            if "\n" in low[marks[at] : marks[at + 1]]:
                at += 1
            else:
                pairs.append((marks[at], marks[at + 1]))
                at += 2
        k = 0
        for i, m in enumerate(WORD.finditer(low)):
            while k < len(pairs) and pairs[k][1] < m.start():
                k += 1
            if i in hits and k < len(pairs) and pairs[k][0] < m.start():
                inside.add(i)
        return inside

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        return self.model.probability(np.array([self.features(t) for t in texts]))


def _odds(with_: Counter, without: Counter, n1: int, n0: int, least: int) -> dict[str, float]:
    """Log-odds of toxic for entries that enough toxic documents hold."""
    return {w: math.log((c + 0.5) / (n1 + 1)) - math.log((without[w] + 0.5) / (n0 + 1)) for w, c in with_.items() if c >= least}


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """A lexicon and its model from (text, label) rows; half of them name the entries' weights, all fit the model.

    The model sees each row with the entries that the other half gave, so that
    entries that hold by chance get no trust. With fewer than five toxic or
    other rows the score is the share of toxic ones.
    """
    y = np.array([label for _, label in rows], int)
    n1 = int(y.sum())
    if n1 < 5 or len(y) - n1 < 5:
        return Lexicon({}, {}, {}, None, (n1 + 1) / (len(y) + 8))
    halves = [[r for i, r in enumerate(rows) if i % 2 == h] for h in (0, 1)]
    features, labels = [], []
    for h in (0, 1):
        lexicon = _entries(halves[1 - h])
        features += [lexicon.features(t) for t, _ in halves[h]]
        labels += [label for _, label in halves[h]]
    out = _entries(rows)
    out.model = Logistic(1.0).fit(np.array(features), np.array(labels, float))
    return out


def _entries(rows: list[tuple[str, int]]) -> Lexicon:
    words, stems, around = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    n = [1, 1]
    for text, label in rows:
        n[label] += 1
        held = WORD.findall(text.lower())
        count = Counter(held)
        words[label].update(count.keys())
        # A stem counts where a document holds two or more words of it.
        begin = Counter(w[:k] for w in held for k in range(STEM[0], min(STEM[1], len(w)) + 1))
        stems[label].update(s for s, c in begin.items() if c >= 2)
    least = max(3, n[1] // 100)
    weight = _odds(words[1], words[0], n[1], n[0], least)
    terms = {w: weight[w] for w in sorted((w for w in weight if weight[w] >= 2.5 and len(w) >= 3), key=lambda w: (-weight[w], w))[:TERMS]}
    weight = _odds(stems[1], stems[0], n[1], n[0], least)
    good = [s for s in weight if weight[s] >= 2.0]
    # Of stems that say the same, the shortest with the highest weight.
    good.sort(key=lambda s: (-round(weight[s], 1), len(s), s))
    kept: dict[str, float] = {}
    for s in good:
        if len(kept) >= STEMS:
            break
        if not any(s.startswith(k) for k in kept):
            kept[s] = weight[s]
    lexicon = Lexicon(terms, kept, {})
    for text, label in rows:
        held = WORD.findall(text.lower())
        near = {w for i, x in enumerate(held) if lexicon.look(x) for w in held[max(0, i - WINDOW) : i + WINDOW + 1]}
        around[label].update(near)
    weight = _odds(around[1], around[0], n[1], n[0], max(10, least))
    lexicon.context = {w: max(-2.0, min(2.0, weight[w])) for w in sorted(weight, key=lambda w: (-abs(weight[w]), w))[:500] if w not in terms}
    lexicon._seen = {}
    return lexicon


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's text leaves 2 modulo 4; such rows teach nothing. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, sample: int = SAMPLE) -> Lexicon:
    """Learns from labelled rows that are not held out, those with the least hash of their id: ``most`` rows and ``sample`` bytes at most.

    A text of more than an eighth of ``sample`` teaches nothing, so no text
    fills the sample. Ids with both labels are left out; of rows that repeat an id one is taken.
    """
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("high")).filter("y = high").select("doc_id", "y")
    some = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = space.save(rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample // 8), "rows")
    # At most ``most`` rows without their texts are numbered here.
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = rows.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= sample).select("doc_id")
    taken = rows.join(within, "doc_id").orderBy("doc_id").toLocalIterator()
    return learn([(r["text"] or "", r["y"]) for r in taken])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    A null text is an empty one and scores like it; rows that repeat score
    alike. Only the text gives the score. Without enough labels all rows score
    the share of toxic labels; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.round(held.value.score([t or "" for t in texts.where(texts.notna(), None)]), 6))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.pandas_udf(run, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
