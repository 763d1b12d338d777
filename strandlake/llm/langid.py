"""Language identification in two steps: the family of a text's language, then the language within it.

Both steps are linear support vector machines over hashed byte grams of the
whole text, one for each pair of families and one for each pair of languages of
a family, so a language is only held against its relatives. Machines are fitted
on the driver from a bounded sample of labelled documents; the corpus is scored
where it lies.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches
from .logistic import sigmoid

#: Labelled documents that the machines are fitted on at most, as many of each language as there are; features; gram lengths.
SAMPLE, BITS, GRAMS = 2000, 12, (1, 2, 3, 4)
#: Weight of the squared norm against the squared hinge losses, and steps of the fit at most.
RIDGE, STEPS = 0.05, 40
UNKNOWN = "und"
#: The families of ISO 639-1 codes. A code that is not here is a family by itself.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la lij oc pt ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "hellenic": "el",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "fil haw id jv mg mi ms su tl",
    "bantu": "ny rw sn sw xh zu",
    "tai": "lo th",
    "austroasiatic": "km vi",
}
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MULTIPLY = np.uint32(0x9E3779B1)


def family(lang: str, families: dict[str, str] | None = None) -> str:
    """The family of a language code, regions left aside (``pt-BR`` is ``pt``)."""
    table = FAMILIES if families is None else families
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in table.items() if code in codes.split()), f"={lang}")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(texts: list[str], bits: int = BITS) -> np.ndarray:
    """Counts of hashed grams of every whole text, a row each: lower case, all that is no letter in ASCII as one space.

    Grams have 1 to 4 bytes of UTF-8; the text stands between spaces. A text
    without letters may give zeros.
    """
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for i, text in enumerate(texts):
        raw = b" ".join(text.lower().encode().translate(_FOLD).split())
        for a, b in ((s, min(s + (1 << 20), len(raw))) for s in range(0, len(raw), 1 << 20)):
            # Neighbouring stretches share the bytes that a gram may reach over.
            part = np.frombuffer(b" " + raw + b" " if b - a == len(raw) else raw[a : b + max(GRAMS) - 1], np.uint8).astype(np.uint32)
            for n in GRAMS:
                code = np.zeros(max(0, min(len(part) - n + 1, len(part) if b - a == len(raw) else b - a)), np.uint32)
                for j in range(n):
                    code |= part[j : j + len(code)] << np.uint32(8 * j)
                code = (code + np.uint32(n)) * _MULTIPLY >> np.uint32(32 - bits)
                out[i] += np.bincount(code, minlength=1 << bits).astype(np.float32)
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def machine(kernel: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Each row's part in the weights of the linear machine with squared hinge losses, for y of 1 and -1.

    ``kernel`` has the rows' inner products plus one, for the bias. Newton steps
    over the support vectors: those that miss the margin solve one linear
    system, until they stay the same.
    """
    # Both sides weigh alike, however many rows they have.
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    beta = np.zeros(len(y))
    support = np.ones(len(y), bool)
    for _ in range(steps):
        at = np.flatnonzero(support)
        beta = np.zeros(len(y))
        beta[at] = np.linalg.solve(kernel[np.ix_(at, at)] + np.diag(ridge * np.mean(np.diag(kernel)) / cost[at]), y[at])
        after = y * (kernel @ beta) < 1
        if (after == support).all() or not after.any():
            break
        support = after
    return beta


class Model:
    """The machines of both steps; labels are languages in sorted order."""

    def __init__(self, families: dict[str, str] | None = None):
        self.families = families
        self.tree: dict[str, list[str]] = {}
        self.pairs: list[tuple[str, str, str]] = []
        self.weights = np.zeros((0, 1), np.float32)

    def fit(self, counts: np.ndarray, langs: list[str]) -> Model:
        known = sorted(set(langs))
        for lang in known:
            self.tree.setdefault(family(lang, self.families), []).append(lang)
        if not known:
            return self
        x = shares(counts)
        scale = (1 / np.sqrt(np.maximum(x.mean(0), 1e-5))).astype(np.float32)
        x *= scale
        kernel = (x @ x.T).astype(np.float64) + 1
        own, groups = np.array(langs), np.array([family(x, self.families) for x in langs])
        weights = []
        for level, labels, sets in [("", groups, sorted(self.tree))] + [(f, own, self.tree[f]) for f in sorted(self.tree)]:
            for a, b in combinations(sets, 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                beta = machine(kernel[np.ix_(rows, rows)], np.where(labels[rows] == a, 1.0, -1.0))
                weights.append(np.append(beta @ x[rows] * scale, beta.sum()))
                self.pairs.append((level, a, b))
        if weights:
            self.weights = np.array(weights, np.float32)
        return self

    def predict(self, counts: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of every row: the mean chance against the other families, times that against the relatives."""
        if not self.tree:
            return [(UNKNOWN, 0.0)] * len(counts)
        chance = sigmoid(3 * (shares(counts) @ self.weights[:, :-1].T + self.weights[:, -1]).astype(np.float64)) if self.pairs else np.zeros((len(counts), 0))

        def best(level: str, sets: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes = np.zeros((len(counts), len(sets)))
            for j, (at, a, b) in enumerate(self.pairs):
                if at == level:
                    votes[:, sets.index(a)] += chance[:, j]
                    votes[:, sets.index(b)] += 1 - chance[:, j]
            return votes.argmax(1), votes.max(1) / (len(sets) - 1) if len(sets) > 1 else np.ones(len(counts))

        groups = sorted(self.tree)
        first, sure = best("", groups)
        within = [best(f, self.tree[f]) for f in groups]
        return [(self.tree[groups[f]][within[f][0][i]], float(sure[i] * within[f][1][i])) for i, f in enumerate(first)]


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's text leaves 2 modulo 4; such rows teach nothing. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _featured(bits: int):
    def run(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for s in range(0, len(texts), 64):
                own = [i for i in range(s, min(s + 64, len(texts))) if has_letter(texts[i])]
                data = []
                for row in grams([texts[i] for i in own], bits):
                    at = np.flatnonzero(row)
                    data.append(at.astype(np.uint32).tobytes() + row[at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in own], pa.string()), pa.array(data, pa.binary())], ["lang", "grams"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, families: dict[str, str] | None = None) -> Model:
    """The model of labelled rows that are not held out: those of least key, ``sample`` at most.

    A row's key is a hash of its id times the rows of its language, so each
    language gives as many rows as it has, up to its even part. Rows of null
    id, text or language teach nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "langid")
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    rows = space.save(known.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("rows")), "languages")
    key = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 1) * F.col("rows")
    keyed = known.join(rows, "lang").withColumn("key", key)
    last = keyed.select("key").orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if last is None:
        return Model(families)
    taken = keyed.filter(F.col("key") <= last).orderBy("key", F.xxhash64("text"), "lang").limit(sample).select("text", "lang")
    got = taken.mapInArrow(_featured(bits), "lang string, grams binary").collect()
    counts = np.zeros((len(got), 1 << bits), np.float32)
    for row, r in zip(counts, got):
        n = len(r["grams"]) // 8
        row[np.frombuffer(r["grams"], np.uint32, n)] = np.frombuffer(r["grams"], np.float32, n, 4 * n)
    return Model(families).fit(counts, [r["lang"] for r in got])


def _identified(held, bits: int):
    def run(batches):
        model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for s in range(0, len(texts), 128):
                part = texts[s : s + 128]
                found = model.predict(grams([t or "" for t in part], bits))
                out += [x if has_letter(t) else (UNKNOWN, 0.0) for t, x in zip(part, found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([round(x, 6) for _, x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, families: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Only the text gives a prediction: a language that labelled rows have, or
    ``und`` with a score of 0 if the text is null or has no letter, or if there
    are no labelled rows. With one language every other text is that one.
    Texts of any length are read whole. Repeated rows get the same values;
    other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fit(docs, sample, bits, families))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_identified(held, bits), "doc_id long, held_out boolean, lang_pred string, score double")
