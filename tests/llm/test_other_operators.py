"""WARC, top-k, sharding, mixing, toxicity, quality, pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import mixing, pii, quality, queries, sharding, topk, toxicity, warc
from strandlake.llm.common import Workspace
from strandlake.llm.logistic import Logistic, auc

# --- WARC ------------------------------------------------------------------

BIG = "<p>" + "x" * 1200 + "</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "http://a/\r\nX: 1", ""), (7, "u", "é" * 600), (8, "u", "é" * 600), (None, "n", BIG), (3, "http://a/3", "small")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha256 string")


def want_roles(rows):
    body = {i: (h or "").encode() for i, (_, _, h) in enumerate(rows)}
    top = {}
    for i, (p, _, _) in enumerate(rows):
        if p is not None:
            top[body[i]] = max(p, top.get(body[i], p))
    out = []
    for i, (p, _, _) in enumerate(rows):
        b = body[i]
        revisit = len(b) >= 1000 and b in top and p != top[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[b] if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES)).collect()
    assert sorted(map(tuple, got), key=str) == want_roles(PAGES)
    assert warc.round_trip(pages(spark, [])).count() == 0


def stored(spark, rows):
    path = Workspace(spark, "warc-test").path
    warc.write_archive(pages(spark, rows), path)
    return path


def test_warc_records_are_whole(spark, tmp_path):
    path = stored(spark, PAGES)
    body = {p: (h or "").encode() for p, _, h in PAGES}
    assert sorted(bytes(r.payload) for r in warc.read_payloads(spark, path).collect()) == sorted({(h or "").encode() for _, _, h in PAGES})
    names = set()
    found = warc.records(spark, path).collect()
    assert len(found) == len(PAGES)
    for r in found:
        (fields, head, block), *rest = warc.parse(bytes(r.record))
        names.add(fields["WARC-Record-ID"])
        revisit = fields["WARC-Type"] == "revisit"
        assert not rest and head.startswith(b"WARC/1.1\r\n") and (r.payload is None) == revisit
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body[r.page_id]).digest()).decode()
        assert block == (b"" if revisit else body[r.page_id])
        assert ("WARC-Refers-To" in fields) == revisit
    assert len(names) == len(PAGES)
    ids = {r.page_id: dict(next(warc.parse(bytes(r.record)))[0]) for r in found}
    assert ids[1]["WARC-Refers-To"] == ids[9]["WARC-Record-ID"]
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r.record) for r in found))
    assert warc.read_warc_files(spark, str(tmp_path / "a.warc")).count() == len(PAGES)


def test_warc_stores_payloads_once_where_rows_repeat(spark):
    rows = [(1, "u", BIG), (1, "u", BIG), (1, "v", BIG), (None, "n", BIG + "2"), (None, "n", BIG + "2"), (2, "w", "tiny"), (2, "w", "tiny")]
    path = stored(spark, rows)
    assert warc.read_payloads(spark, path).count() == 3
    assert sorted(map(tuple, warc.read_back(spark, path).collect()), key=str) == want_roles(rows)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_warc_without_broadcasts(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert sorted(map(tuple, warc.round_trip(pages(spark, PAGES)).collect()), key=str) == want_roles(PAGES)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def changed(spark, path, page_id, old, new):
    """The archive with the header bytes of one page's record changed."""
    heads = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    other = F.encode(F.replace(text, F.lit(old), F.lit(new)), "UTF-8")
    heads.withColumn("header", F.when(F.col("page_id") == page_id, other).otherwise(F.col("header"))).write.parquet(f"{path}-changed/headers")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{path}-changed/payloads")
    return f"{path}-changed"


def test_warc_reads_what_the_header_bytes_say(spark):
    path = changed(spark, stored(spark, PAGES), 3, "WARC-Type: response", "WARC-Type: resource")
    assert {r.record_type for r in warc.read_back(spark, path).collect() if r.page_id == 3} == {"resource"}
    ids = {r.page_id: next(warc.parse(bytes(r.record)))[0]["WARC-Record-ID"] for r in warc.records(spark, path).collect()}
    path = changed(spark, stored(spark, PAGES), 1, ids[9], ids[8])
    with pytest.raises(Exception, match="no response with this payload"):
        warc.read_back(spark, path).collect()
    path = changed(spark, stored(spark, PAGES), 4, "sha1:", "sha1:A")
    with pytest.raises(Exception):
        warc.read_back(spark, path).collect()


def test_warc_detects_damage(spark):
    space = Workspace(spark, "warc-damage")
    warc.write_archive(pages(spark, PAGES[:3]), space.path)
    bad = spark.read.parquet(f"{space.path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    bad.write.parquet(f"{space.path}/damaged/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, f"{space.path}/damaged").collect()


# --- top-k -----------------------------------------------------------------


def brute_top(rows, k, every):
    """Over rows, not ids: a row that repeats an id is a row like others."""
    v = []
    for i, x in rows:
        if i is not None and x and all(c is not None and np.isfinite(c) for c in x):
            v.append((i, [int(np.floor(64 * np.float64(np.float32(c)))) for c in x]))
    out = []
    for n, (q, x) in enumerate(v):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for m, (c, y) in enumerate(v) if m != n and len(y) == len(x))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 4096])
def test_top_k_against_brute_force(spark, block):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(17)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    rows += [(300, None), (301, [None] * 17), (302, [float("nan")] * 17), (303, [float("inf")] + [0.0] * 16), (304, []), (None, rows[0][1]), (5, rows[5][1]), (305, [1.0, 2.0]), (310, [0.5, -1.0])]
    rows += [(20, rows[7][1]), (21, rows[8][1])]
    table = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.top_k(table, 7, 5, block=block).collect()))
    assert got == brute_top(rows, 7, 5)
    assert topk.top_k(table.limit(0)).count() == 0


def test_top_k_takes_rows_that_repeat_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(table, 2).collect())) == brute_top(rows, 2, 20) == [(20, 1, 1, 4096), (20, 1, 1, 8192), (20, 2, 1, 2048), (20, 2, 1, 4096)]


def test_top_k_scores_are_exact():
    r = random.Random(3)
    for most in (2**20, 2**30, 2**31):
        q, x = (np.array([[r.randrange(-most, most) for _ in range(2)] for _ in range(6)]) for _ in range(2))
        assert topk.products(q, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(s, t)) for t in x] for s in q]
    assert topk.products(np.array([[2**30, 1]]), np.array([[2**30, 1]]))[0, 0] == 2**60 + 1
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**40, 0]]), np.array([[2**40, 0]]))


def test_top_k_of_large_numbers(spark):
    rows = [(0, [2.0**24, 2.0**-6]), (1, [2.0**24, 2.0**-6]), (2, [2.0**24, 0.0]), (3, [2.0**24, 2.0**-5]), (4, [-(2.0**24), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(table, 4).orderBy("rank").collect()] == [(0, 1, 3, 2**60 + 2), (0, 2, 1, 2**60 + 1), (0, 3, 2, 2**60), (0, 4, 4, -(2**60) + 64)]


def test_top_k_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-64, 64, (500, 64)), rng.integers(-64, 64, (9, 64))
    for s in topk.LEVELS:
        assert (topk.statistics(q.astype(float), s) @ topk.statistics(x.astype(float), s).T >= q @ x.T - 1e-6).all()
    smooth = np.repeat(rng.integers(-64, 64, (4000, 4)), 16, axis=1)
    search = topk.Search(np.arange(3), np.arange(3), smooth[:3], 5)
    for a in range(0, 4000, 500):
        search.add(np.arange(a, a + 500), np.arange(a, a + 500), smooth[a : a + 500])
    assert search.exact < search.pairs / 2


# --- sharding --------------------------------------------------------------


def test_store_versions_and_compaction(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, ("text %d " % (i % 50)) * 30, "en", "s", i, "x", i) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long, _shard string, arrival int")
    store, rows = sharding.shard(docs, arrivals=9, target=60_000, smallest=2_000, fan_in=3)
    assert sorted(map(str, rows.collect())) == sorted(map(str, docs.collect()))
    version, shards = store.manifest()
    assert sum(s.rows for s in shards) == 900 and len(shards) < 9 and version == store.versions()[-1]
    assert store.due(shards) is None and version > 9
    assert {x.tag for x in store.read(docs.schema, tag="tag").select("tag").distinct().collect()} == {s.name for s in shards}
    before = store.manifest()
    with pytest.raises(sharding.Conflict):
        store.commit(version - 1, [])
    assert store.manifest() == before
    store.append(docs.limit(5))
    assert store.read(docs.schema).count() == 905
    _, empty = sharding.shard(docs.limit(0), arrivals=2)
    assert empty.count() == 0 and empty.columns == docs.columns


def test_store_keeps_the_versions_that_readers_hold(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    store = sharding.Store(spark, Workspace(spark, "store-test").path, target=1 << 20, smallest=1 << 10, fan_in=2, retain=3)
    for k in range(4):
        store.append(docs.filter(F.col("doc_id") % 4 == k).coalesce(1))
    held = store.read(docs.schema, version=4)
    assert store.compact(docs.schema) >= 2
    last = store.versions()[-1]
    assert store.versions() == [last - 2, last - 1, last] and len(store.manifest()[1]) < 4
    assert [store.read(docs.schema, version=v).count() for v in store.versions()] == [40] * 3
    assert held.count() == 40 if 4 in store.versions() else True
    with pytest.raises(KeyError):
        store.read(docs.schema, version=1)


def test_store_writes_all_arrivals_in_one_pass(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    store = sharding.Store(spark, Workspace(spark, "store-test").path)
    added = store.append(docs.mapInPandas(count, docs.schema), (F.col("doc_id") % 5).cast("int"), 6)
    assert seen.value == 200 and [s.rows for s in added] == [40] * 5 + [0] and store.versions() == list(range(1, 7))
    assert store.read(docs.schema).count() == 200 and store.read(docs.schema, version=2).count() == 80


# --- mixing ----------------------------------------------------------------


def mixed_corpus(spark, n=240):
    r = random.Random(6)
    vocab = {d: [f"{d}{i}" for i in range(60)] for d in "abc"}
    rows = []
    for i in range(n):
        d = "a" if i % 6 < 4 else "b" if i % 6 == 4 else "c"
        rows.append((i, " ".join(r.choice(vocab[d]) for _ in range(r.randrange(1, 80))), d))
    return rows


def test_mixing_meets_targets(spark):
    rows = mixed_corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    weights = {"a": 0.4, "b": 0.35, "c": 0.25}
    got = mixing.mix_rates(docs, docs, weights).collect()
    assert len(got) == len(rows) and all(x.rate >= 0 for x in got)
    right = sum(x.domain == rows[x.doc_id][2] for x in got) / len(got)
    assert right > 0.97
    total = np.zeros(3)
    for x in got:
        total += x.rate * x.n_tokens * np.array(x.posterior)
    assert np.allclose(total / total.sum(), [0.4, 0.35, 0.25], atol=2e-3)
    mixed = mixing.mix(docs, docs, weights)
    assert mixed.columns == docs.columns
    counts = {d: 0 for d in "abc"}
    for x in mixed.collect():
        counts[x.domain] += len(x.text.split())
    whole = sum(counts.values())
    assert all(abs(counts[d] / whole - w) < 0.05 for d, w in weights.items())


def test_mixing_drops_nothing_by_default(spark, monkeypatch):
    """Ambiguous documents that gain must not push the pure ones of the largest domain below 1."""
    given = [("a", 900, 100, [1.0, 0.0]), ("b", 50, 100, [0.5, 0.5]), ("c", 50, 100, [0.0, 1.0])]
    monkeypatch.setattr(mixing, "posteriors", lambda docs, *rest: spark.createDataFrame(given, "key string, copies long, n_tokens long, posterior array<double>"))
    docs = spark.createDataFrame([(1, "x y"), (2, "z w")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "A"), (2, "B")], "doc_id long, domain string")
    mixture = mixing.Mixture.fit(docs, labelled)
    rates = {x.key: x.r for x in mixture.table.select("key", mixture.rates().alias("r")).collect()}
    assert rates["a"] == 1.0 and min(rates.values()) >= 1.0 and rates["c"] > 2
    assert mixture.reached[1] == pytest.approx(mixture.goal[1], rel=0.05)


def test_mixing_edges(spark):
    rows = mixed_corpus(spark, 60) + [(100, None, None), (101, "", "a"), (None, "a1 a2", "a"), (0, "a1", "b"), (102, "b1 " * 50_000, "b")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, domain string, rate string")
    got = mixing.mix_rates(docs, docs.select("doc_id", "text", "domain")).collect()
    assert len(got) == len(rows) and {x.n_tokens for x in got if x.doc_id in (100, 101)} == {0}
    assert mixing.mix_rates(docs.limit(0), docs.select("doc_id", "text", "domain")).count() == 0
    alone = mixing.mix_rates(docs, docs.select("doc_id", "text", "domain").limit(0)).collect()
    assert {x.rate for x in alone} == {1.0} and {x.domain for x in alone} == {None}
    assert mixing.mix(docs, docs.select("doc_id", "text", "domain").limit(0)).count() == len(rows)
    with pytest.raises(ValueError):
        mixing.targets([1.0, 2.0], [0.0, 0.0])


# --- toxicity --------------------------------------------------------------


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_automaton_against_edit_distance():
    r = random.Random(9)
    terms = ["idiot", "scum", "worthless", "pathetic", "idiom", "moron", "ab"]
    auto = toxicity.Automaton(terms)
    words = terms + ["idi0t", "idot", "scums", "wrthles", "xpathetic", "morno", "", "idiotidiot"]
    words += ["".join(r.choice("idotmrn") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    for w in words:
        near = [(edits(w, t), t) for t in terms if edits(w, t) <= auto.edits(t)]
        want = (min(near)[1], min(near)[0]) if near else None
        assert auto.find(w) == want, w


def toxic_corpus(n=600):
    r = random.Random(10)
    base = [f"word{i}" for i in range(200)]
    bad = ["idiot", "moron", "worthless", "pathetic"]
    rows = []
    for i in range(n):
        words = [r.choice(base) for _ in range(r.randrange(5, 60))]
        y = int(i % 6 == 0)
        if y:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        elif i % 6 == 1:
            words.insert(2, '"you are an idiot"')
            words.insert(2, "said")
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_holds_out_and_ranks(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, "word1 word2 idi0t word3 mor0n wor thless pathetlc word4", "x"), (9001, None, "x"), (9002, "", "x"), (None, "idiot moron idiot", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {x.doc_id: x for x in got}
    for i, x in by.items():
        assert x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    held = [(y, by[i].score) for i, _, y in rows if by[i].held_out]
    assert auc(np.array([y for y, _ in held]), np.array([s for _, s in held])) > 0.97
    assert by[9000].predicted == 1 and by[9001].score == by[9002].score < 0.3 and by[None].predicted == 1
    # Held-out labels teach nothing: turning them around changes no score.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.score(docs, flipped).collect()} == {i: x.score for i, x in by.items()}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert len({x.score for x in toxicity.score(docs, labels.limit(0)).collect()}) == 1


# --- quality ---------------------------------------------------------------


def quality_corpus(n=400):
    r = random.Random(12)
    rows = []
    for i in range(n):
        y = int(i % 5 != 0)
        text = " ".join(r.choice(["some", "plain", "words", "of", "prose,", "here."]) for _ in range(r.randrange(10, 90))) if y else " | ".join("###" + "%" * r.randrange(1, 9) for _ in range(r.randrange(5, 60)))
        rows.append((i, text, r.choice(["en", "fr", None]), f"s{r.randrange(5)}", len(text), y))
    return rows


def test_quality_co_training(spark):
    rows = quality_corpus()
    docs = spark.createDataFrame([r[:5] + ("x",) for r in rows] + [(800, None, None, None, None, "x"), (801, "", "en", "s1", 0, "x"), (None, "some words", "en", "s1", 10, "x"), rows[0][:5] + ("x",)], "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows[:250]], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {x.doc_id: x for x in got}
    rest = rows[250:]
    assert auc(np.array([r[5] for r in rest]), np.array([by[r[0]].score for r in rest])) > 0.98
    assert sum(by[r[0]].kept == bool(r[5]) for r in rest) >= 0.97 * len(rest)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {x.score for x in quality.classify(docs, labels.limit(0)).collect()} == {1.0}


def test_quality_pseudo_labels_come_from_all_documents(spark, tmp_path):
    """The surest of 6,000 unlabelled documents, each features once: no document is beyond a pool."""
    n = 6000
    models = [Logistic().fit(np.array([[-1.0], [1.0]] * 20), np.array([0.0, 1.0] * 20)) for _ in range(2)]
    models[1].mean, models[1].scale, models[1].w = np.zeros(67), np.ones(67), np.zeros(68)
    rows = [(i, "s", "en", 10.0, f"k{i % (n - 50):05d}", [float(i % (n - 50)) / n]) for i in range(n)]
    free = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars double, key string, t array<double>").repartition(7).drop("doc_id")
    choose = quality.surest(free, Workspace(spark, "test"), 0.5)
    first = choose(models, [5, 40], set())
    wanted = lambda ks: {f"k{k:05d}" for k in ks}
    assert {p[2] for p in first if p[:2] == (0, 1)} == wanted(range(n - 90, n - 50)) and len([p for p in first if p[:2] == (0, 1)]) == 40
    second = choose(models, [5, 40], {p[2] for p in first})
    assert {p[2] for p in second if p[:2] == (0, 1)} == wanted(range(n - 130, n - 90))


def test_quality_scores_every_unlabelled_document(spark, monkeypatch):
    rows = quality_corpus(300)
    docs = spark.createDataFrame([(i, f"{r[1]} {i}", *r[2:5]) for i, r in enumerate(rows * 16)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, r[5], 0) for i, r in enumerate(rows[:200])], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "surest", lambda free, space: seen.append(free.count()) or (lambda models, most, taken: []))
    assert quality.fit(docs, labels) is not None and seen == [300 * 16 - 200]


def test_boosted_trees_learn_and_calibrate():
    r = random.Random(1)
    rows = []
    for _ in range(400):
        x = [r.randrange(n) for n in pii.LEVELS]
        good = (x[7] and x[1] > 1) or (x[0] == 2 and x[6])
        rows.append((x, r.random() < 0.2, 9.0 if good else 0.0, 0.0 if good else 9.0))
    model = pii.Boosted.fit(rows)
    assert sum((model.probability(x) >= model.threshold) == (p > 0) for x, _, p, _ in rows) >= 0.97 * len(rows)
    assert pii.Boosted.fit([]).trees == []


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(20)
    prose = lambda n, s: " ".join(random.Random(s).choice(["alpha", "beta", "gamma", "delta", "kappa", "omega"]) + str(random.Random(s * 1000 + i).randrange(400)) for i in range(n))
    rows = []
    for i in range(120):
        rows.append((i, "#### | " * 40 if i % 8 == 0 else prose(r.randrange(40, 90), i), "en" if i % 3 else "fr", "src", 300))
    leak = prose(30, 777)
    rows += [(500, rows[1][1], "en", "src", 300), (501, rows[1][1] + " extra", "en", "src", 300), (502, prose(20, 5000) + " " + leak, "en", "src", 300), (503, None, None, None, None)]
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    assert sorted(out.columns) == sorted(docs.columns)
    ids = {x.doc_id for x in out.collect()}
    assert {i for i in range(120) if i % 8} <= ids and not ids & {500, 501, 502} and not {i for i in range(120) if i % 8 == 0} & ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_drops_near_copies_from_80_percent(spark):
    words = [f"v{i}" for i in range(104)]  # 100 shingles of five words
    # One changed word changes five shingles: two of them leave 90 of 110 (0.818), three 85 of 115 (0.739).
    changed = lambda *at: " ".join("new" + w if i in at else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, changed(20, 60)), (3, changed(10, 40, 70))], "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.distinct(spark, docs, "").collect()} == {1, 3}


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())
