"""Cases that once went wrong: colliding words, small rates, long texts in a sample, repeated ids, left folders, two writers."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontam, minhash, mixing, pii, sharding, suffix_dedup, toxicity
from strandlake.llm.common import NONALNUM, SPACE, Workspace, word_hashes, word_spans, words_of


def thue_morse(n, first="a", second="b"):
    s = first
    swap = str.maketrans(first + second, second + first)
    while len(s) < n:
        s += s.translate(swap)
    return s[:n]


def test_words_of_one_form_do_not_collide():
    for n in (64, 256, 1024, 2048, 4096):
        a, b = thue_morse(n), thue_morse(n, "b", "a")
        h, _ = words_of([a.encode(), b.encode()], SPACE)
        assert len(set(h.tolist())) == 2
    # The same word gives the same hash wherever it stands, for every length around the lanes' edges.
    for n in (1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200):
        w = thue_morse(n).encode()
        h, offsets = words_of([w, b"x  " + w + b" y", b"q " + w.upper()], SPACE)
        assert h[0] == h[2] == h[-1] and offsets.tolist() == [0, 1, 4, 6]
    words = {f"{a}{b}" for a in "abcdefgh\x00" for b in ["", *map(str, range(2000))]}
    buf = np.frombuffer((" ".join(sorted(words)) + " ").encode(), np.uint8)
    assert len(np.unique(word_hashes(buf, *word_spans(buf, SPACE)))) == len(words)


def test_colliding_forms_are_no_near_duplicates_and_no_contamination(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, f"{a} one two three four five"), (2, f"{b} one two three four five"), (3, a), (4, b)], "doc_id long, text string")
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())
    items = spark.createDataFrame([(7, a)], "item_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontam.report(docs, items).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_a_hit_is_confirmed_by_its_bytes(monkeypatch):
    """Even if all words hashed alike, only equal words would be hits."""
    monkeypatch.setattr(decontam, "word_hashes", lambda buf, starts, ends: np.full(len(starts), 5, np.uint64))
    text, other = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(12))
    probes = decontam.Probes([("i", text.encode())], 10)
    found = list(decontam.scan([text.encode(), other.encode()], probes))
    assert found[0][1] == [(0, 12)] and found[1][1] == [] and NONALNUM[0x20]


def test_probes_of_few_blocks_are_kept():
    class Held:
        value = [("i", b"a b c")]

    for _ in range(10):
        list(decontam._scanner(Held, 10)(iter([])))
    assert len(decontam._BUILT) <= decontam.KEPT


@pytest.mark.parametrize("rate", [0.004, 0.0149, 0.5, 1.0, 1.0004, 2.9996])
def test_copies_keep_the_mean_of_any_rate(spark, rate):
    n = 400_000
    got = spark.range(n).select(F.sum(mixing.copies(F.lit(rate), F.col("id"), F.lit("x")))).first()[0]
    part = rate % 1
    assert abs(got - n * rate) <= 5 * (n * part * (1 - part)) ** 0.5


def test_one_long_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "vile slur " * 2 + "plain words" if i % 2 else "plain words only") for i in range(200)] + [(i, "x" * 50_000) for i in range(1000, 1040)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    lexicon = toxicity.fit(docs, labels, sample=40_000)
    assert lexicon.model is not None and "slur" in lexicon.terms


def test_the_row_that_stays_of_a_repeated_id_does_not_depend_on_order(spark):
    rows = [(1, f"text number {i} of this id with words", i) for i in range(30)] + [(2, "other", 0), (None, "null", 1)]
    make = lambda r, n: spark.createDataFrame(r, "doc_id long, text string, id long").repartition(n)
    got = [sorted(map(str, minhash.drop_near_duplicates(make(r, n)).collect())) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert got[0] == got[1] and len(got[0]) == 3


def test_folders_of_dead_writers_go(spark):
    store = sharding.Store(spark, Workspace(spark, "orphans").path)
    docs = spark.range(20).selectExpr("id as doc_id", "string(id) as text")
    store.append(docs)
    # An append that dies after its rows are written leaves a folder.
    store._write(docs)
    assert store.orphans() == [] and len(store.orphans(-60)) == 1
    store.expire()
    assert len(store.orphans(-60)) == 1
    store.expire(older=-60)
    assert store.orphans(-60) == [] and store.read(docs.schema).count() == 20


def test_two_writers_at_once(spark):
    path = Workspace(spark, "writers").path
    schema = spark.range(1).selectExpr("id as doc_id", "string(id) as text").schema
    failed = []

    def write(k):
        try:
            store = sharding.Store(spark, path, fan_in=2)
            for n in range(3):
                store.append(spark.range(k * 100 + n * 10, k * 100 + n * 10 + 10).selectExpr("id as doc_id", "string(id) as text"))
            store.compact(schema)
        except Exception as e:  # noqa: BLE001 - a thread's error would be lost
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    rows = sharding.Store(spark, path).read(schema).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(30), *range(100, 130)])


def test_addresses_of_object_stores():
    assert suffix_dedup.store_uri("s3a://bucket/x") == "s3://bucket/x" and suffix_dedup.store_uri("file:///tmp/x") == "file:///tmp/x" and suffix_dedup.store_uri("/tmp/x") == "/tmp/x"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_context_selects_personal_data_on_the_tables(spark):
    """The trees that the documents teach split on context, and the same number is taken or left by what stands around it."""
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    used = {pii.FEATURES[i] for tree in model.trees for i in (tree[0], tree[2][0], tree[3][0])}
    assert len(model.trees) > 5 and used & {"before", "after", "lead", "words", "figures"}
    held = ["They wrote to 212-555-0100 on monday", 'token = "cb1a9fee212-555-0100c7ab"', "the form 4539/1488/0343/6467 was sent", "key-4539/1488/0343/6467/aa9", "see 10(.)1(.)2(.)3 there", 'build "a10(.)1(.)2(.)3b"', "ask jo at mail dot com there"]
    got = [r["spans"].split(":")[0] for r in pii.find(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string").repartition(1), model).orderBy("doc_id").collect()]
    assert got == ["phone", "", "card", "", "ip", "", "email"]


def test_negatives_weigh_as_much_as_positives_of_their_kind():
    rows = pii.balanced([([0, 1], False, 3.0, 0.0), ([0, 2], False, 0.0, 600.0), ([1, 1], False, 0.0, 5.0), ([0, 2], True, 2.0, 8.0)])
    assert [r[3] for r in rows] == [0.0, 3.0, 5.0, 2.0]


def test_shards_take_less_room_than_the_sessions_codec(spark, tmp_path):
    """Arrivals and merged shards both lie on disk for readers of earlier versions."""
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(300))) for i in range(600)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "plain"))
    store, rows = sharding.shard(docs, path=str(tmp_path / "store"))
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))
    assert sum(s.size for s in store.manifest()[1]) < 0.8 * size(tmp_path / "plain")
