"""Quality classification by co-training two views.

One view sees the text, the other the page's metadata (source, language,
length). Each is a logistic model. Over rounds, each view scores all unlabelled
documents, labels those that it is surest of and hands them to the other. Both are then
calibrated on labelled rows kept aside, and their calibrated log-odds are
combined for every document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, unused
from .logistic import Logistic

#: Labelled rows fitted on, rounds, pseudo-labels a view gives a round, surety they need.
LABELLED, ROUNDS, GIVEN, SURE = 4000, 4, 200, 0.95
#: Below this probability of label 1 a document is rejected.
KEEP = 0.5
_HASHED = 32

#: Classes of bytes whose shares are text features (fixed values).
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*@^~", b"<>{}[]()=;:/\\_+-", b"'\"`", bytes(range(128, 256))]
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members), _k] = 1


def text_features(texts: list[bytes]) -> np.ndarray:
    """Shares of byte classes and statistics of words and lines; an empty text gives zeros."""
    out = np.zeros((len(texts), len(CLASSES) + 9))
    for i, t in enumerate(texts):
        if not t:
            continue
        words = t.split()
        lines = t.split(b"\n")
        n = max(1, len(words))
        out[i, : len(CLASSES)] = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _CLASS / len(t)
        out[i, len(CLASSES) :] = (
            np.log1p(len(t)),
            len(t) / n,
            len(set(words)) / n ** 0.9,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            sum(w.isupper() for w in words) / n,
            sum(len(w) <= 3 for w in words) / n,
            len(set(lines)) / len(lines),
            np.log1p(len(t) / len(lines)),
            sum(w.endswith((b".", b",")) for w in words) / n,
        )
    return out


def page_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the stated length; nulls are a value of their own."""
    out = np.zeros((len(source), 2 * _HASHED + 3))
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        out[i, zlib.crc32(b"s" + str(s).encode()) % _HASHED] = 1
        out[i, _HASHED + zlib.crc32(b"l" + str(g).encode()) % _HASHED] = 1
        known = n is not None and n == n
        length = np.log1p(max(0.0, float(n))) if known else 0.0
        out[i, -3:] = (length, (length - 7) ** 2, float(not known))
    return out


#: A pseudo-label: view that gives it, label, key of the features, text features, page features.
Pick = tuple[int, int, str, list, list]


@dataclass
class CoTrained:
    """Two views, their calibrations, and the combination."""

    text: Logistic
    page: Logistic
    text_scale: Logistic
    page_scale: Logistic
    both: Logistic

    @staticmethod
    def fit(xt: np.ndarray, xp: np.ndarray, y: np.ndarray, surest: Callable[[list[Logistic], list[int], set[str]], list[Pick]], rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
        """Every fourth labelled row calibrates; the rest train. ``surest`` finds a round's pseudo-labels among the unlabelled."""
        aside = np.arange(len(y)) % 4 == 3
        train = ~aside
        known = [y[train].astype(float), y[train].astype(float)]
        views = (xt, xp)
        rows = [x[train] for x in views]
        taken: set[str] = set()
        models = [Logistic().fit(r, k) for r, k in zip(rows, known)]
        share = y[train].mean()
        # As many of each class as its share, so that the classes stay balanced as they are.
        most = [max(1, int(given * (1 - share))), max(1, int(given * share))]
        for _ in range(rounds):
            picks = surest(models, most, taken)
            if not picks:
                break
            for giver, taker in ((0, 1), (1, 0)):
                got = [p for p in picks if p[0] == giver]
                if got:
                    rows[taker] = np.concatenate((rows[taker], np.array([p[3 + taker] for p in got])))
                    known[taker] = np.concatenate((known[taker], [float(p[1]) for p in got]))
            taken |= {p[2] for p in picks}
            models = [Logistic().fit(r, k) for r, k in zip(rows, known)]
        logits = [m.logit(x[aside]) for m, x in zip(models, views)]
        scales = [Logistic(0.1).fit(t[:, None], y[aside].astype(float)) for t in logits]
        calibrated = np.c_[[s.logit(t[:, None]) for s, t in zip(scales, logits)]].T
        return CoTrained(*models, *scales, Logistic(0.1).fit(calibrated, y[aside].astype(float)))

    def probability(self, xt: np.ndarray, xp: np.ndarray) -> np.ndarray:
        views = [s.logit(m.logit(x)[:, None]) for s, m, x in ((self.text_scale, self.text, xt), (self.page_scale, self.page, xp))]
        return self.both.probability(np.c_[views[0], views[1]])


_FEATURES = "doc_id {}, source string, lang string, n_chars double, key string, t array<double>"
_SCORED = "view int, label int, logit double, key string, source string, lang string, n_chars double, t array<double>"


def _texts(texts: pd.Series) -> np.ndarray:
    return text_features([(x or "").encode() for x in texts.where(texts.notna(), None)])


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of documents; ``key`` is the same where they are."""
    for f in frames:
        t = _texts(f["text"])
        page = [repr((s, g, None if n != n else n)).encode() for s, g, n in zip(f["source"], f["lang"], f["n_chars"])]
        f["key"] = [hashlib.blake2b(x.tobytes() + p, digest_size=16).hexdigest() for x, p in zip(t, page)]
        f["t"] = list(t)
        yield f.drop(columns="text")


def _surest_of(models: list[Logistic], most: list[int], taken: set[str], sure: float):
    """The surest rows of a partition for each view and label, rows of equal features once."""
    need = np.log(sure / (1 - sure))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], pd.DataFrame] = {}
        for f in frames:
            if not len(f):
                continue
            xs = np.stack(f["t"].to_list()), page_features(list(f["source"]), list(f["lang"]), list(f["n_chars"]))
            free = ~f["key"].isin(taken).to_numpy()
            for view, (model, x) in enumerate(zip(models, xs)):
                logit = np.round(model.logit(x), 9)
                for label in (0, 1):
                    at = free & ((logit if label else -logit) >= need)
                    if at.any():
                        new = f[at].assign(view=view, label=label, logit=np.abs(logit[at]))
                        held = pd.concat([best[view, label], new]) if (view, label) in best else new
                        best[view, label] = held.drop_duplicates("key").sort_values(["logit", "key"], ascending=[False, True]).head(most[label])
        for held in best.values():
            yield held[["view", "label", "logit", "key", "source", "lang", "n_chars", "t"]]

    return run


def surest(free: DataFrame, space: Workspace, sure: float = SURE) -> Callable[[list[Logistic], list[int], set[str]], list[Pick]]:
    """Scores all of ``free`` with each view and gives the surest rows of each view and label, those of equal features once.

    Each partition keeps its best ones; what reaches the driver is bounded by
    the number of pseudo-labels of a round.
    """
    rounds = iter(range(1 << 30))

    def choose(models: list[Logistic], most: list[int], taken: set[str]) -> list[Pick]:
        found = space.save(free.mapInPandas(_surest_of(models, most, set(taken), sure), _SCORED), f"round-{next(rounds)}")
        # Equal keys have equal features: any row of a key is the same row.
        once = found.dropDuplicates(["view", "label", "key"])
        out = []
        for view in (0, 1):
            for label in (0, 1):
                rows = once.filter((F.col("view") == view) & (F.col("label") == label)).orderBy(F.col("logit").desc(), "key").limit(most[label]).collect()
                page = page_features([r["source"] for r in rows], [r["lang"] for r in rows], [r["n_chars"] for r in rows])
                out += [(view, label, r["key"], r["t"], list(p)) for r, p in zip(rows, page)]
        return out

    return choose


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """Fits on ``labelled`` labelled documents, those with the least hash of their id, and pseudo-labels from all others.

    Ids that have both labels are left out. None if a class has fewer than
    eight rows.
    """
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "quality")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_high")).filter("y = _high").select("doc_id", "y")
    slim = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    held = space.save(slim.mapInPandas(_measured, _FEATURES.format(docs.schema["doc_id"].dataType.simpleString())), "features")
    some = known.join(held.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    given = held.join(F.broadcast(some.select("doc_id", F.col("y").cast("int").alias("y"))), "doc_id")
    # Of rows that repeat an id one is fitted on: what is collected has ``labelled`` rows at most.
    fields = ["key", "t", "source", "lang", "n_chars", "y"]
    given = given.groupBy("doc_id").agg(F.min(F.struct(*fields)).alias("row")).select("doc_id", "row.*").collect()
    given.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["t"]))
    y = np.array([r["y"] for r in given])
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None
    xt = np.array([r["t"] for r in given], float)
    xp = page_features([r["source"] for r in given], [r["lang"] for r in given], [r["n_chars"] for r in given])
    free = space.save(held.join(labels.select("doc_id"), "doc_id", "left_anti").drop("doc_id"), "free")
    space.drop("features")
    return CoTrained.fit(xt, xp, y, surest(free, space))


def score(docs: DataFrame, model: CoTrained | None, into: str) -> DataFrame:
    """``docs`` with a column ``into``: the probability of label 1; 1.0 everywhere without a model."""
    if model is None:
        return docs.withColumn(into, F.lit(1.0))
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, source, lang, n_chars in parts:
            xt = _texts(text)
            yield pd.Series(np.round(held.value.probability(xt, page_features(list(source), list(lang), list(n_chars))), 6))

    return docs.withColumn(into, F.pandas_udf(run, "double")("text", "source", "lang", F.col("n_chars").cast("double")))


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, score, kept of every row of ``docs`` (doc_id, text, lang, source, n_chars).

    Any column may be null: a null text is an empty one, other nulls are values
    of their own. Repeated rows score alike, each on its own row. Without
    enough labels every row has score 1 and is kept; an empty table gives an
    empty result. Extra columns are ignored.
    """
    scored = score(docs.select("doc_id", "text", "lang", "source", "n_chars"), fit(docs, labels), "score")
    return scored.select("doc_id", "score", (F.col("score") >= keep).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns, whatever the names of others than the five used.

    Nulls, ties, repeated rows and missing labels are as in ``classify``; an
    empty table stays empty.
    """
    name = unused("score", docs)
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= keep).drop(name)
