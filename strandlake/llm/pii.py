"""Personal data spans by candidate gradient boosting, in DataFrame functions.

Generators with high recall propose spans of four kinds: the plain formats and
looser ones (spelt-out addresses, numbers with other separators). The format's
own check (parts of an address, check digits, number of digits) rules out what
can't be personal data; boosted trees decide on the rest from the kind and
the context. They learn from plain candidates that pass their check, against
what the corpus holds besides: candidates that fail it, near misses (versions,
dates, part numbers, handles), and every other number of the texts, whose places
(keys, amounts, versions, tables) speak against each kind. Of each kind both
sides weigh alike, however rare one of them is. The check is the label, so
neither it nor what it reads is a feature. The score is
calibrated on a fold kept aside, and a threshold of calibrated precision selects
what is redacted. Plain matches that pass their check are always selected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The plain formats. Possessive runs and the looks behind keep each scan linear and change no match:
#: a match begins at the start of its run, or where the match before ended.
PLAIN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The looser formats.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: ?[(\[{]at[)\]}] ?[a-z0-9-]++(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[a-z0-9-]++)++| at [a-z0-9-]++(?: dot [a-z0-9-]++)++)",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,3}(?: ?(?:[(\[{]\.[)\]}]|[(\[{]dot[)\]}]) ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?: ?[./_] ?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Near misses of the formats, which are negatives of the training: handles and hosts without a dot, three dotted
#: numbers, two or three groups of four digits, other groups of digits.
NEAR = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2}+(?!\.?[0-9])",
    "card": r"(?<![0-9])(?<![0-9][ ./_-])[0-9]{4}(?:[ ./_-][0-9]{4}){1,2}+(?![ ./_-]?[0-9])",
    "phone": r"(?<![0-9+().-])(?<![0-9)][ .-])(?![0-9]{3}[ -][0-9]{3}[ -][0-9]{4}(?![0-9]))(?![0-9]{4}(?:[ -][0-9]{4})++(?![0-9]))[0-9]{1,5}(?:[ -][0-9]{1,6}){1,4}+(?![ .-]?[0-9])",
}
#: Every other number, with its signs or within what it is glued to, is a negative of each kind.
NUMBER = r"(?<![0-9])[0-9]++(?:[ ./_-][0-9]++)*+"
#: What a text must hold before a format is tried: cheap, and implied by the format.
HINT = {("email", None): "@", ("ip", None): r"[0-9]\.[0-9]++\.[0-9]", ("card", None): r"[0-9]{4}[ ./_-][0-9]{4}", ("phone", None): "[0-9][ -][0-9]", ("email", False): "@", ("phone", False): r"\+[0-9]", ("ip", False): r"[0-9]\.[0-9]", ("card", False): r"[0-9](?:[ -]?[0-9]){7}", ("email", True): r"(?i)[(\[{]at[)\]}]| at [a-z0-9-]+ dot ", ("ip", True): r"(?i)[0-9] ?[(\[{](?:\.|dot)[)\]}]", ("card", True): r"[0-9]{4} ?[./_] ?[0-9]{4}", ("phone", True): r"[0-9]{3}[ .-][0-9]{4}"}
#: Words that speak of personal data (fixed values).
CUES = r"(?i)(mail|contact|phone|call|tel|fax|mobile|card|visa|pay|address|host|server|\bip\b)"
#: Words that speak of other numbers (fixed values).
OTHER = r"(?i)(order|invoice|version|release|isbn|issn|part|serial|ticket|\bcase|item|page|\bref|sku|model|section|figure|table|\bno\b|\bid\b)"
#: Numbers that are no card and fail the check digit, for each one that passes it by chance.
CHANCE = 9
#: Features and how many values each has: what training brings to the driver is bounded by their product. Rounds, shrinkage, precision of the threshold.
FEATURES, LEVELS = ("kind", "before", "after", "lead", "words", "figures", "cue", "other"), (4, 4, 4, 4, 4, 4, 2, 2)
#: The kind of what is a negative of each kind, until its rows are told.
ANY = len(KINDS)
ROUNDS, RATE, PRECISION = 24, 0.4, 0.9


def _found(text: Column, kind: str, loose: bool | None) -> Column:
    """Candidates of one format (None: its near misses): array of structs with start and end in code points.

    The text is split at the matches; the lengths of the parts and of the
    matches between them give the places.
    """
    pattern = (NEAR if loose is None else LOOSE if loose else PLAIN)[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = "cast(array() as array<struct<start:int,end:int>>)"
    walk = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"))),
        F.struct(F.lit(0).alias("at"), F.expr(empty).alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )
    make = F.transform(
        walk,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            F.lit(bool(loose)).alias("loose"),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("hit"),
            F.when(x["start"] > 0, F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))).otherwise("").alias("left"),
            F.substring(text, x["end"] + 1, F.lit(1)).alias("right"),
        ),
    )
    return F.when(text.rlike(HINT[kind, loose]), make).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int,loose:boolean,hit:string,left:string,right:string>>)"))


def candidates(text: Column) -> Column:
    """All candidates of a text; plain and loose ones may overlap. Null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_found(text, k, loose) for loose in (False, True) for k in KINDS))


def near_misses(text: Column) -> Column:
    """What has the look of a kind but can't be of it, as candidates."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_found(text, k, None) for k in KINDS))


def others(text: Column) -> Column:
    """The numbers of a text outside its candidates, in the form of candidates of kind ANY without places.

    What stands to the left is taken from the number before on, so a text with
    many numbers costs no more than its length.
    """
    cleared = F.coalesce(text, F.lit(""))
    for kind in KINDS:
        for loose, formats in ((False, PLAIN), (True, LOOSE)):
            # Bound to a name, so that each step evaluates the one before it once.
            cleared = F.transform(F.array(cleared), lambda t: F.when(t.rlike(HINT[kind, loose]), F.regexp_replace(t, formats[kind], "\ufffc")).otherwise(t))[0]  # noqa: B023
    cut = F.transform(F.array(cleared), lambda t: F.struct(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)).alias("hits"), F.split(t, NUMBER, -1).alias("gaps")))
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    return F.flatten(F.transform(cut, lambda c: _placed(c["hits"], c["gaps"], at)))


def _placed(hits: Column, gaps: Column, at) -> Column:
    return F.transform(
        hits,
        lambda h, i: F.struct(
            F.lit(0).alias("start"),
            F.lit(ANY).alias("kind"),
            F.lit(0).alias("end"),
            F.lit(False).alias("loose"),
            h.alias("hit"),
            F.right(F.concat(at(hits, i - 1), at(gaps, i)), F.lit(24)).alias("left"),
            F.left(F.concat(at(gaps, i + 1), at(hits, i + 1)), F.lit(1)).alias("right"),
        ),
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits holds."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1)) % 10 == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(~twice, d).when(d > 4, 2 * d - 9).otherwise(2 * d)


def normal(c: Column) -> Column:
    """A loose candidate in its plain form."""
    mail = F.regexp_replace(F.regexp_replace(c["hit"], r"(?i) ?[(\[{]at[)\]}] ?| at ", "@"), r"(?i) ?[(\[{]dot[)\]}] ?| dot ", ".")
    ip = F.regexp_replace(c["hit"], r"(?i) ?[(\[{](?:\.|dot)[)\]}] ?", ".")
    return F.when(~c["loose"], c["hit"]).when(c["kind"] == 0, mail).when(c["kind"] == 1, ip).otherwise(c["hit"])


def valid(c: Column) -> Column:
    """Whether the candidate passes the check of its kind."""
    plain, digits = normal(c), _digits(c["hit"])
    octets = F.forall(F.split(plain, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    return (
        F.when(c["kind"] == 0, plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"))
        .when(c["kind"] == 1, octets)
        .when(c["kind"] == 2, F.length(digits).between(14, 19) & luhn(digits))
        .otherwise(F.length(digits).between(10, 15))
    )


def _side(ch: Column) -> Column:
    return F.when(ch.rlike(r"^\p{L}"), 1).when(ch.rlike("^[0-9]"), 2).when(ch.rlike(r"^[^\s]"), 3).otherwise(0)


def features(c: Column) -> Column:
    """Kind and context of a candidate as small whole numbers, in the order of FEATURES."""
    values = [
        c["kind"],
        _side(F.right(c["left"], F.lit(1))),
        _side(c["right"]),
        _side(F.right(F.rtrim(c["left"]), F.lit(1))),
        F.least(F.regexp_count(c["left"], F.lit(r"\p{L}+")), F.lit(3)),
        F.least(F.floor((F.length(_digits(c["left"])) + 1) / 2), F.lit(3)),
        c["left"].rlike(CUES).cast("int"),
        c["left"].rlike(OTHER).cast("int"),
    ]
    return F.array(*(v.cast("int") for v in values))


@dataclass
class Boosted:
    """Trees of depth two over small whole numbers, a calibration and a threshold."""

    base: float = 0.0
    #: (feature, cut, then (feature, cut, low, high) below and above).
    trees: list[tuple] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def fit(rows: list[tuple[list[int], bool, float, float]], rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION) -> Boosted:
        """From (features, aside, positives, negatives). Rows aside calibrate; without any, the others do."""
        self = Boosted()
        train = [(x, p, n) for x, aside, p, n in rows if not aside and p + n]
        check = [(x, p, n) for x, aside, p, n in rows if aside and p + n] or train
        pos, neg = sum(p for _, p, _ in train), sum(n for _, _, n in train)
        self.base = math.log((pos + 1) / (neg + 1))
        score = [self.base] * len(train)
        for _ in range(rounds):
            slopes = [(p - (p + n) * _sigmoid(s), (p + n) * _sigmoid(s) * (1 - _sigmoid(s))) for (_, p, n), s in zip(train, score)]
            tree = _grow([x for x, _, _ in train], slopes, rate)
            if tree is None:
                break
            self.trees.append(tree)
            score = [s + _walk(tree, x) for s, (x, _, _) in zip(score, train)]
        points = [(self.raw(x), p, n) for x, p, n in check]
        for _ in range(50):  # Newton steps of a two-parameter logistic, with a little pull to (1, 0)
            g = [0.5 * (self.slope - 1), 0.5 * self.shift]
            h = [0.5, 0.0, 0.5]
            for s, p, n in points:
                q = _sigmoid(self.slope * s + self.shift)
                d, v = (p + n) * q - p, (p + n) * q * (1 - q)
                g[0], g[1] = g[0] + d * s, g[1] + d
                h = [h[0] + v * s * s, h[1] + v * s, h[2] + v]
            det = h[0] * h[2] - h[1] ** 2
            if det < 1e-12:
                break
            da, db = (h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det
            most = max(abs(da), abs(db), 1.0)
            self.slope, self.shift = self.slope - da / most, self.shift - db / most
            if max(abs(da), abs(db)) < 1e-9:
                break
        # The least score down to which the precision holds; 0.5 if no row lies between, and none at all if it never holds.
        by: dict[float, list[float]] = {}
        for s, p, n in points:
            held = by.setdefault(_sigmoid(self.slope * s + self.shift), [0.0, 0.0])
            held[0], held[1] = held[0] + p, held[1] + n
        kept, least, next_ = [0.0, 0.0], math.inf, -math.inf
        for q, (p, n) in sorted(by.items(), reverse=True):
            kept = [kept[0] + p, kept[1] + n]
            if kept[0] >= precision * (kept[0] + kept[1]):
                least, next_ = q, -math.inf
            else:
                next_ = max(next_, q)
        self.threshold = max(0.05, min(least, 0.5) if next_ < 0.5 and (least < math.inf or not by) else least)
        return self

    def raw(self, x: list[int]) -> float:
        return self.base + sum(_walk(t, x) for t in self.trees)

    def probability(self, x: list[int]) -> float:
        return _sigmoid(self.slope * self.raw(x) + self.shift)

    def column(self, x: Column) -> Column:
        """The calibrated probability as an expression over an array of features."""
        node = lambda t: F.when(x[t[0]] <= t[1], t[2]).otherwise(t[3])
        total = F.lit(self.base)
        for f, cut, low, high in self.trees:
            total = total + F.when(x[f] <= cut, node(low)).otherwise(node(high))
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))

    def selects(self, x: Column) -> Column:
        """Whether the calibrated probability reaches the threshold."""
        return self.column(x) >= F.lit(self.threshold)


@dataclass
class Kinds:
    """One boosted model for each kind: what speaks against one kind says nothing of another that lacks negatives."""

    models: list[Boosted]

    @property
    def trees(self) -> list[tuple]:
        return [t for m in self.models for t in m.trees]

    def probability(self, x: list[int]) -> float:
        return self.models[x[0]].probability(x)

    def selects(self, x: Column) -> Column:
        out = F.lit(False)
        for k, m in enumerate(self.models):
            out = F.when(x[0] == k, m.selects(x)).otherwise(out)
        return out


def _sigmoid(t: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, t))))


def _walk(tree: tuple, x: list[int]) -> float:
    f, cut, low, high = tree
    f, cut, a, b = low if x[f] <= cut else high
    return a if x[f] <= cut else b


def _stump(xs: list[list[int]], slopes: list[tuple[float, float]], rate: float) -> tuple[float, tuple]:
    """(gain, (feature, cut, low value, high value)) of the best cut; a leaf is a cut that none is above."""
    g, h = sum(s[0] for s in slopes), sum(s[1] for s in slopes)
    best = (0.0, (0, LEVELS[0], rate * g / (h + 1), 0.0))
    for f, levels in enumerate(LEVELS):
        by = [[0.0, 0.0] for _ in range(levels)]
        for x, (a, b) in zip(xs, slopes):
            by[x[f]][0] += a
            by[x[f]][1] += b
        low = [0.0, 0.0]
        for cut in range(levels - 1):
            low = [low[0] + by[cut][0], low[1] + by[cut][1]]
            gain = low[0] ** 2 / (low[1] + 1) + (g - low[0]) ** 2 / (h - low[1] + 1) - g**2 / (h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut, rate * low[0] / (low[1] + 1), rate * (g - low[0]) / (h - low[1] + 1)))
    return best


def _grow(xs: list[list[int]], slopes: list[tuple[float, float]], rate: float) -> tuple | None:
    gain, (f, cut, _, _) = _stump(xs, slopes, rate)
    if gain <= 1e-6:
        return None
    sides = [[i for i, x in enumerate(xs) if (x[f] <= cut) == low] for low in (True, False)]
    return (f, cut, *(_stump([xs[i] for i in side], [slopes[i] for i in side], rate)[1] for side in sides))


def train(docs: DataFrame) -> Kinds:
    """Fits on the plain candidates, the near misses and the other numbers of all documents.

    Positive are plain candidates that pass their check. Of the numbers that
    fail the check digit one in CHANCE is a negative: so many pass it by
    chance. What is no plain candidate and has a cue word before it is left out,
    as it may be personal data in a notation that no format knows.

    They are counted by feature row first, so what reaches the driver is bounded
    by the product of LEVELS and in practice is some hundred rows. Of each kind
    the negatives are weighed so that they come to as much as the positives.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold")
    tagged = lambda found, near: F.transform(found, lambda c: F.struct(c.alias("c"), F.lit(near).alias("near")))
    plain = F.concat(*(_found(F.coalesce("text", F.lit("")), k, False) for k in KINDS))
    rest = F.concat(near_misses(F.col("text")), others(F.col("text")))
    found = docs.select(fold, F.explode(F.concat(tagged(plain, False), tagged(rest, True))).alias("f")).select("fold", "f.c", "f.near")
    c = F.col("c")
    rows = found.select((F.col("fold") == 0).alias("aside"), features(c).alias("x"), (~F.col("near") & valid(c)).alias("y"), (~F.col("near") & (c["kind"] == 2)).alias("drawn"), "near")
    rows = rows.filter(~F.col("near") | (F.col("x")[FEATURES.index("cue")] == 0))
    count = lambda of: F.sum(of.cast("int"))
    y, drawn = F.col("y"), F.col("drawn")
    rows = rows.groupBy("x", "aside").agg(count(y).alias("p"), count(~y & ~drawn).alias("n"), count(~y & drawn).alias("chance")).orderBy("x", "aside").collect()
    told = [(list(r["x"]), bool(r["aside"]), float(r["p"]), r["n"] + r["chance"] / CHANCE) for r in rows]
    # A number that stands by itself says nothing of addresses in letters; one that is part of a longer token does.
    kinds = lambda x: x[:1] if x[0] < ANY else range(0 if x[1] or x[2] in (1, 2) else 1, ANY)
    rows = balanced([([k, *x[1:]], aside, p, n) for x, aside, p, n in told for k in kinds(x)])
    return Kinds([Boosted.fit([r for r in rows if r[0][0] == k]) for k in range(ANY)])


def balanced(rows: list[tuple[list[int], bool, float, float]]) -> list[tuple[list[int], bool, float, float]]:
    """The rows with the negatives of each kind and fold weighed to the sum of its positives, where it has both."""
    total: dict[tuple, list[float]] = {}
    for x, aside, p, n in rows:
        held = total.setdefault((x[0], aside), [0.0, 0.0])
        held[0], held[1] = held[0] + p, held[1] + n
    share = {k: p / n if p and n else 1.0 for k, (p, n) in total.items()}
    return [(x, aside, p, n * share[x[0], aside]) for x, aside, p, n in rows]


def spans(docs: DataFrame, model: Kinds | None = None, base: str = "base", more: str = "more") -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of (start, kind, end, name), sorted, in code points, end exclusive.

    ``base`` has the plain matches that pass their check; ``more`` the other
    candidates that the model selects and that no base span overlaps. Neither
    may be a column of ``docs``.
    """
    if unused(base, docs) != base or unused(more, docs) != more:
        raise ValueError(f"the column name {base} or {more} is taken")
    held = unused("found", docs)
    model = train(docs) if model is None else model
    names = F.array(*(F.lit(k) for k in KINDS))
    slim = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.element_at(names, c["kind"] + 1).alias("name"))
    found = docs.withColumn(held, candidates(F.col("text")))
    found = found.withColumn(base, F.array_sort(F.transform(F.filter(held, lambda c: ~c["loose"] & valid(c)), slim)))
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    chosen = F.filter(held, lambda c: c["loose"] & clear(c) & _scored(model, c))
    return found.withColumn(more, F.array_sort(F.transform(chosen, slim))).drop(held)


def _scored(model: Boosted, c: Column) -> Column:
    """Whether a candidate passes its check and its calibrated score reaches the threshold; features are computed once."""
    picked = F.transform(F.array(features(c)), model.selects)
    return valid(c) & picked[0]


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Kinds | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Null ids and repeated rows are rows like
    others; extra columns are ignored; an empty table gives an empty result.
    """
    found = spans(docs.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    both = F.array_sort(F.concat("base", "more"))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"), F.size("more").cast("long").alias("n_added"))


def redact(docs: DataFrame, model: Kinds | None = None) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets.

    Other columns stay whatever their names; a null text stays null. Repeated
    rows and null ids are rows like others; an empty table stays empty.
    """
    base = unused("base", docs)
    more = unused("more", docs)
    found = spans(docs, model, base, more)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["name"]), F.lit("]")).alias("out"), s["end"].alias("at")),
    ).otherwise(acc)
    walk = F.aggregate(F.array_sort(F.concat(base, more)), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), walk)).drop(base, more)
