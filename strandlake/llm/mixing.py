"""Soft-membership mixing of domains to target weights, in DataFrame functions.

A naive Bayes classifier, fitted on labelled documents, gives each document a
posterior over domains from hashed words. Nonnegative rates of documents are
then fitted so that the expected tokens of each domain, sum over documents of
rate * tokens * posterior, meet the targets: least squares by projected
gradient, one aggregation over all documents for each step.

Words are rows of a generator that compiled code folds back into one row for
each text before the one small shuffle. Evidence is summed in whole numbers, so
the order of rows changes nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, unused

#: Labelled documents that the classifier is fitted on, hash slots of words, gradient steps.
LABELLED, SLOTS, STEPS = 4000, 2048, 40
#: Share exponent of the default targets: below 1, small domains gain.
TEMPERATURE = 0.7
#: Largest miss of a domain, as a share of its present tokens, at which the steps end.
TOLERANCE = 1e-4
#: Whole-number units of a log-likelihood.
UNIT = 1_000_000


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each whitespace-separated word, with ``keep``; ``at`` is its place. Empty text has one empty word."""
    return docs.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("at", "word"))


def slot(word: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")


def fit(docs: DataFrame, labelled: DataFrame, most: int = LABELLED, slots: int = SLOTS) -> tuple[list[str], list[list[int]], list[float]]:
    """(domains, log-likelihoods by domain and slot in units, log-priors) from documents and (doc_id, domain).

    Fitted on the ``most`` labelled documents with the least hash of their id.
    What reaches the driver is domains x slots numbers.
    """
    known = labelled.filter("doc_id is not null and domain is not null").select("doc_id", "domain").distinct()
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    priors = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = words(rows, "domain").filter("word != ''").groupBy("domain", slot(F.col("word"), slots).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    domains = sorted(priors)
    held = {d: [1.0] * slots for d in domains}
    for r in counts.collect():
        held[r["domain"]][r["slot"]] += r["n"]
    likelihood = [[round(UNIT * math.log(v / sum(held[d]))) for v in held[d]] for d in domains]
    total = sum(priors.values()) or 1
    return domains, likelihood, [math.log(priors[d] / total) for d in domains]


def posteriors(docs: DataFrame, likelihood: list[list[int]], prior: list[float], slots: int = SLOTS) -> DataFrame:
    """key (digest of the text), copies, n_tokens, posterior: one row for each distinct text of ``docs``."""
    keyed = docs.select("text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    some = F.col("word") != ""
    place = slot(F.col("word"), slots) + 1
    sums = []
    for i, row in enumerate(likelihood):
        weights = F.from_json(F.lit(json.dumps(row)), "array<bigint>")
        sums.append(F.sum(F.when(some, F.element_at(weights, place)).otherwise(F.lit(0))).alias(f"s{i}"))
    first = F.sum((F.col("at") == 0).cast("long")).alias("copies")
    folded = words(keyed, "key").groupBy("key").agg(first, F.sum(some.cast("long")).alias("n"), *sums)
    # Equal texts were added up: the sums are whole multiples.
    logs = F.array(*(F.lit(p) + F.col(f"s{i}") / F.col("copies") / UNIT for i, p in enumerate(prior)))
    shifted = folded.withColumn("_l", logs).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    whole = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    return shifted.select("key", "copies", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), F.transform("_e", lambda x: F.round(x / whole, 9)).alias("posterior"))


def rate(p: Column, path: list[list[float]], least: float = 0.0) -> Column:
    """The rate after the gradient steps of ``path``: from 1, minus each step's inner product, never below ``least``."""
    if not path:
        return F.lit(1.0)
    steps = F.from_json(F.lit(json.dumps(path)), "array<array<double>>")
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(least), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))


def targets(totals: list[float], weights: list[float] | None) -> list[float]:
    """Token totals to reach: the least with these weights that leave no domain below what it has."""
    live = [max(t, 0.0) for t in totals]
    if weights is None:
        weights = [t**TEMPERATURE for t in live]
    if len(weights) != len(totals) or min(weights, default=0) < 0 or not sum(weights):
        raise ValueError("one nonnegative weight for each domain, not all zero")
    share = [w / sum(weights) for w in weights]
    whole = max((t / s for t, s in zip(live, share) if s > 0), default=0.0)
    return [whole * s for s in share]


@dataclass
class Mixture:
    """A fitted mixture: the classifier, the gradient steps, and the posteriors of the texts it was fitted on."""

    domains: list[str]
    likelihood: list[list[int]]
    prior: list[float]
    path: list[list[float]] = field(default_factory=list)
    #: Rates are this at least: 1 with the default targets, which leave no domain below what it has, else 0.
    least: float = 0.0
    goal: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    #: key, copies, n_tokens, posterior of each distinct text.
    table: DataFrame | None = None

    @staticmethod
    def fit(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> Mixture:
        domains, likelihood, prior = fit(docs, labelled)
        self = Mixture(domains, likelihood, prior, least=1.0 if weights is None else 0.0)
        space = Workspace(docs.sparkSession, "mixing")
        self.table = held = space.save(posteriors(docs, likelihood, prior), "posteriors")
        if not domains:
            return self

        def expected(r: Column) -> list[float]:
            # Thousandths in whole numbers: the sum is the same in any order.
            mass = [F.coalesce(F.sum(F.col("copies") * F.round(F.col("n_tokens") * r * F.col("posterior")[i] * 1000).cast("long")), F.lit(0)).alias(f"t{i}") for i in range(len(domains))]
            return [x / 1000 for x in held.agg(*mass).first()]

        have = expected(F.lit(1.0))
        self.goal = targets(have, None if weights is None else [float(weights.get(d, 0.0)) for d in domains]) if sum(have) else have
        self.reached = have
        for _ in range(steps):
            step = [(n - g) / max(t, 1.0) for n, g, t in zip(self.reached, self.goal, have)]
            if max(map(abs, step), default=0.0) <= tolerance:
                break
            self.path.append([round(x, 12) for x in step])
            before, self.reached = self.reached, expected(self.rates())
            # Documents at the least rate may hold a domain above its target: the steps end when nothing moves.
            if self.least and max(abs(n - b) / max(t, 1.0) for n, b, t in zip(self.reached, before, have)) <= tolerance / 10:
                break
        return self

    def rates(self) -> Column:
        """The rate of each row of ``table``."""
        return rate(F.col("posterior"), self.path, self.least)


def mix_rates(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate for every row of ``docs`` (doc_id, text).

    ``labelled`` has (doc_id, domain); texts come from ``docs``. ``weights``
    gives each domain's target share (0 if absent); by default shares are the
    present ones to the power TEMPERATURE, and no rate is below 1. Null and empty texts have no tokens
    and the prior as posterior. Null ids and repeated rows are rows like
    others; equal texts have equal rates. Without labelled documents every rate
    is 1, domain null and posterior empty; an empty table gives an empty
    result. Extra columns are ignored.

    With T the domains' present tokens, the objective is the sum of squared
    misses, each divided by T, and steps are scaled by 1 / tokens; in these
    units the Hessian's rows sum to 1, so a step of 1 never overshoots.
    """
    mixture = Mixture.fit(docs, labelled, weights, steps, tolerance)
    names = F.from_json(F.lit(json.dumps(mixture.domains)), "array<string>")
    top = F.when(F.size("posterior") > 0, F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1))
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key")).join(mixture.table, "key")
    return rows.select("doc_id", "n_tokens", top.alias("domain"), "posterior", F.round(mixture.rates(), 6).alias("rate"))


def copies(rate_: Column, *key: Column) -> Column:
    """A whole number with the rate as its mean, the same on every run: the hash of the key decides the fraction, however small."""
    unit = F.xxhash64(*key).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return (F.floor(rate_) + (unit < rate_ - F.floor(rate_)).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, steps: int = STEPS) -> DataFrame:
    """``docs`` with every row repeated by its rate, rounded to a whole number so that the mean holds.

    Rates are joined by the digest of the text; rows that repeat an id each
    take the rate of their own text. Null and empty texts have the rate of the
    prior; a null id is a value of the hash that decides the fraction. Columns
    are kept whatever their names. Without labelled documents every row stays
    once; an empty table stays empty.
    """
    mixture = Mixture.fit(docs, labelled, weights, steps)
    if not mixture.domains:
        return docs
    key = unused("key", docs)
    rates = mixture.table.select(F.col("key").alias(key), mixture.rates().alias(rate := unused("rate", docs)))
    joined = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).join(rates, key)
    times = copies(F.col(rate), F.col("doc_id"), F.col(key))
    every = F.array_repeat(F.lit(1), times)
    return joined.withColumn(unused("copy", joined), F.explode(every)).select(*docs.columns)
