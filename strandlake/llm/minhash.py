"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document is posted under its coordinate values; a pair of documents is
a candidate if it collides on ``matches`` of the COORDINATES, which a pair at
the threshold of similarity does but for a probability of MISSED.

* Documents with the same shingle set are one class and are posted once.
* Documents that share fewer values than that with anybody are done: their
  posts go no further (prefix).
* A list is first merged with one member alone, its leader: the member whose
  values the most others have, which is what a group's members were copied from.
  Collisions with leaders are counted, the best leader above the match threshold
  is confirmed on the full sets.
* Lists whose members then are in one component are skipped. Documents that
  still collide on enough lists with another component go on to an exact join
  of their full sets (``crossing``).

Every step is one plan at all sizes: joins carry no hints, so a side is
broadcast only where its written size is below Spark's own threshold.
Confirmation is exact, on the 64-bit hashes of the full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, U64, Workspace, as_long, bounded_batches, chunks, mix, texts_of, unused, words_of
from .components import components, roots

#: Coordinates of a signature, minima mixed in each, probability that a pair at the threshold collides too seldom.
COORDINATES, ROWS, MISSED = 32, 3, 1e-6
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**63, COORDINATES * ROWS, np.uint64) * U64(2) + U64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES * ROWS, np.uint64)
_ORDER = _RNG.integers(1, 2**63, 64, np.uint64) * U64(2) + U64(1)


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        words, offsets = words_of(texts[a:b], SPACE)
        rolled = np.zeros(max(0, len(words) - width + 1), U64)
        for j in range(width):
            rolled += words[j : j + len(rolled)] * _ORDER[j]
        rolled = mix(rolled)
        for i in range(b - a):
            first, last = offsets[i], offsets[i + 1]
            if last - first >= width:
                out.append(np.unique(rolled[first : last - width + 1]))
            elif last > first:
                out.append(mix((words[first:last] * _ORDER[: last - first]).sum(keepdims=True) + U64(last - first)))
            else:
                out.append(np.zeros(0, U64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, COORDINATES): each coordinate mixes ROWS minima of the set."""
    out = np.zeros((len(sets), COORDINATES), U64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    held = np.concatenate([sets[i] for i in full])
    offsets = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for c in range(COORDINATES):
        value = np.full(len(full), c + 1, U64)
        for r in range(c * ROWS, (c + 1) * ROWS):
            value = mix(value * _ORDER[r % ROWS] + np.minimum.reduceat(held * _MUL[r] ^ _ADD[r], offsets))
        out[full, c] = value
    return out


def matches(percent: int, coordinates: int = COORDINATES, rows: int = ROWS, missed: float = MISSED) -> int:
    """The match threshold: a pair at ``percent`` shares fewer coordinates with a probability of ``missed`` at most."""
    q, below, least = (percent / 100) ** rows, 0.0, 0
    while least < coordinates:
        below += math.comb(coordinates, least) * q**least * (1 - q) ** (coordinates - least)
        if below > missed:
            break
        least += 1
    return max(1, least)


def _sign(width: int):
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in chunks(texts):
                sets = shingles(texts[a:b], width)
                coords = signature(sets)
                mixed = [(mix(s).sum(), mix(s ^ _ORDER[0]).sum()) for s in sets]
                values = pa.ListArray.from_arrays(np.arange(0, coords.size + 1, COORDINATES, dtype=np.int32), pa.array(as_long(coords.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(as_long(np.array([x for x, _ in mixed], U64))), pa.array(as_long(np.array([y for _, y in mixed], U64))), values],
                    ["doc_id", "n_shingles", "k1", "k2", "coords"],
                )

    return run


def _confirm(percent: int, width: int):
    def run(batches):
        for batch in batches:
            left, right = shingles(texts_of(batch.column("text_a")), width), shingles(texts_of(batch.column("text_b")), width)
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64)
            keep = (100 * shared >= percent * (total - shared)) & (shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("parent"), pa.array(keep)], ["node", "parent", "linked"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                held = shingles(texts[a:b], width)
                offsets = np.cumsum([0, *map(len, held)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), batch.column("component").slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(as_long(np.concatenate(held))))], ["node", "component", "held"])

    return run


def met(nodes: DataFrame, least: int, space: Workspace) -> DataFrame:
    """(node, weight, values): the coordinate values that a node shares with others, of nodes that share ``least`` or more.

    ``weight`` adds up the lengths of the values' lists; the text that a group's
    members were copied from has the most of all.
    """
    posts = nodes.select("node", F.explode("coords").alias("value"))
    lists = space.save(posts.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    shared = posts.join(lists, "value").groupBy("node").agg(F.sum("n").alias("weight"), F.collect_set("value").alias("values"))
    return space.save(shared.filter(F.size("values") >= least), "met")


def leaders(shared: DataFrame, least: int, space: Workspace) -> DataFrame:
    """(node, parent): of the nodes that lead the node's lists, the one it meets most, if it meets it ``least`` times.

    A list is led by its member of the largest weight (the smaller id of
    equals), so ways up never turn back.
    """
    posts = shared.select("node", "weight", F.explode("values").alias("value"))
    first = space.save(posts.groupBy("value").agg((-F.max(F.struct("weight", -F.col("node")))["col2"]).alias("leader")), "first")
    led = posts.join(first, "value").filter("node != leader").groupBy("node").agg(F.collect_list("leader").alias("all"))
    times = F.transform(F.array_distinct("all"), lambda x: F.struct(F.size(F.filter("all", lambda y: y == x)).alias("n"), (-x).alias("parent")))
    best = led.select("node", F.array_max(times).alias("best")).filter(F.col("best.n") >= least)
    return space.save(best.select("node", (-F.col("best.parent")).alias("parent")), "best")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, parent, linked) of pairs, from the full sets of both texts; a parent's text is shuffled once."""
    child = docs.join(pairs, docs.doc_id == pairs.node).select("node", "parent", F.col("text").alias("text_a"))
    heads = pairs.select(F.col("parent").alias("head")).distinct()
    head = docs.join(heads, docs.doc_id == heads["head"]).select(F.col("head").alias("parent"), F.col("text").alias("text_b"))
    return child.join(head, "parent").select("node", "parent", "text_a", "text_b").mapInArrow(_confirm(percent, width), "node long, parent long, linked boolean")


def unsettled(shared: DataFrame, label: DataFrame, least: int, space: Workspace) -> tuple[DataFrame, int]:
    """(node, component) of the nodes that may have links out of their component, and how many there are.

    A list whose members are all in one component is skipped. A link that is
    missing has ``least`` of the others in common, at both of its ends.
    """
    placed = space.save(shared.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "values"), "placed")
    posts = placed.select("node", "component", F.explode("values").alias("value"))
    mixed = posts.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("value")
    mixed = space.save(mixed, "mixed")
    open_ = posts.join(mixed, "value").groupBy("node").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("n"))
    open_, seen = space.counted(open_.filter(F.col("n") >= least).select("node", "component"), "open", F.count(F.lit(1)).alias("n"))
    return open_, seen["n"]


def crossing(nodes: DataFrame, docs: DataFrame, space: Workspace, percent: int, width: int) -> DataFrame:
    """(a, b): the components of all linked pairs of ``nodes`` (node, component) in different components.

    An exact prefix join on the full sets. Shingles that no other component has
    come first in the order of a set, then the others by how many sets hold
    them. Two linked sets share one that stands among the first of both, and
    one that another component has: lists within one component are skipped.
    So copies with edits of their own that are linked to what they were copied
    from, or too far from it, meet nobody here, however many they are.
    """
    sets = docs.join(nodes, docs.doc_id == nodes.node).select("node", "component", "text").mapInArrow(_sets(width), "node long, component long, held array<long>")
    sets = space.save(sets, "sets")
    share = percent / 100.0
    posts = sets.select("node", "component", F.size("held").alias("size"), F.explode("held").alias("shingle"))
    live = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("shingle", "n")
    live = space.save(live, "live")
    held = posts.join(live, "shingle").groupBy("node", "component", "size").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("live"))
    # Places in the order count from 0; ``reach`` of them can be the first that a linked set shares.
    dead, reach = F.col("size") - F.size("live"), F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1
    front = F.transform(F.slice("live", 1, F.greatest(reach - dead, F.lit(0)).cast("int")), lambda x, i: F.struct(x["shingle"].alias("shingle"), (i + dead).alias("at")))
    ready = held.filter(F.size("live") >= F.ceil(share * F.col("size") - 1e-9)).select("node", "component", "size", F.explode(front).alias("f"))
    ready = space.save(ready.select("node", "component", "size", "f.shingle", "f.at"), "ready")
    x, y = ready.alias("x"), ready.alias("y")
    need = F.ceil(share * (F.col("x.size") + F.col("y.size")) / (1 + share) - 1e-9)
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("x.node") != F.col("y.node"))
    ordered = (F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")))
    within = (F.col("x.at") <= F.col("x.size") - need) & (F.col("y.at") <= F.col("y.size") - need)
    pairs = x.join(y, "shingle").filter(apart & ordered & within).select(F.col("x.node").alias("p"), F.col("y.node").alias("q")).distinct()
    pairs = space.save(pairs, "pairs")
    left = sets.select(F.col("node").alias("p"), F.col("component").alias("a"), F.col("held").alias("left"))
    right = sets.select(F.col("node").alias("q"), F.col("component").alias("b"), F.col("held").alias("right"))
    both = pairs.join(left, "p").join(right, "q").withColumn("n", F.size(F.array_intersect("left", "right")))
    return both.filter(100 * F.col("n") >= percent * (F.size("left") + F.size("right") - F.col("n"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their distinct ``width``-word shingles. A linked pair shares fewer
    coordinates than ``matches`` asks for with a probability of MISSED at most.

    Null or empty texts: no shingles, linked with nothing, kept. A null doc_id
    has nothing to be named by: component_id null, kept, linked with nothing.
    Rows of one doc_id are one document: a repeated row changes nothing, and
    texts that share an id share its component. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    space, least = Workspace(spark, "minhash"), matches(percent)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = space.save(docs.mapInArrow(_sign(width), "doc_id long, n_shingles long, k1 long, k2 long, coords array<long>"), "signed")
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    # Equal sets are one class, named by its smallest id.
    classes = space.save(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("coords").alias("coords")), "classes")
    shared = met(classes, least, space)
    linked = confirmed(leaders(shared, least, space), docs, percent, width).filter("linked")
    label = roots(linked.groupBy("node").agg(F.min("parent").alias("parent")), space)
    open_, n = unsettled(shared, label, least, space)
    links = [crossing(open_, docs, space, percent, width)] if n else []
    # Ids whose rows have different sets tie the classes of these.
    several = usable.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low != high").select("doc_id")
    several, seen = space.counted(several, "several", F.count(F.lit(1)).alias("n"))
    if seen["n"]:
        held = usable.join(several, "doc_id").join(classes.drop("coords"), ["k1", "k2"]).select("doc_id", "node").distinct()
        links.append(_named(_named(held, "node", label), "doc_id", label).select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    if links:
        joined = components(links[0].unionByName(links[1]) if len(links) > 1 else links[0], space)
        label = space.save(_named(label, "component", joined).unionByName(joined), "tied")
    # Some member names a component until here: the smallest one is found now.
    names = label.groupBy(F.col("component").alias("name")).agg(F.least(F.min("node"), F.first("component")).alias("component_id"))
    names = space.save(names, "names")
    placed = classes.select("k1", "k2", "node").join(label, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("name"))
    of = space.save(placed.join(names, "name", "left").select("k1", "k2", F.coalesce("component_id", "name").alias("component_id")), "of")
    space.drop("classes", "lists", "met", "first", "best", "placed", "mixed", "open", "sets", "live", "ready", "pairs", "several", "tied", "names")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(of, ["k1", "k2"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(own, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _named(rows: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its component, if it has one."""
    name = label.select(F.col("node").alias(column), F.col("component").alias("name_"))
    return rows.join(name, column, "left").withColumn(column, F.coalesce("name_", column)).drop("name_").select(*rows.columns)


def drop_near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that link to a smaller doc_id; one row stays of repeated ids, that of the least text.

    Of rows that repeat both id and text, that of the least hash of all columns
    stays. Rows with a null id and texts without words stay. Columns are kept whatever
    their names; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "neardrop")
    found = space.save(near_duplicates(docs, percent, width).filter("doc_id is not null"), "found")
    id_ = unused("id", docs)
    gone = found.filter("not kept").select(F.col("doc_id").alias(id_)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(id_), "left_anti")
    twice, seen = space.counted(found.filter("kept").groupBy(F.col("doc_id").alias(id_)).count().filter("count > 1").select(id_), "twice", F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return left
    once = left.join(twice, F.col("doc_id") == F.col(id_), "left_anti")
    again = left.join(twice, F.col("doc_id") == F.col(id_), "left_semi")
    # All columns travel as one struct, so the least of an id is found by an aggregate that combines before its shuffle.
    least = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias(id_))
    return once.unionByName(least.select(f"{id_}.*"))
