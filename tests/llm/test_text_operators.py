"""Operators over documents against brute force on small, awkward inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontam, minhash, pii, suffix_dedup

DOCS = "doc_id long, text string, extra string"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], schema)


def corpus():
    base = prose(1, 300)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 90, 200)]
    far = [" ".join(words[:150]) + " " + prose(7, 150)]
    texts = [base, base, *near, *far, "", None, "one two", "One  TWO", "same\tfive words are here", prose(2, 4000, 50), "é ü ñ " * 80, "aaaa" * 200, "Straße straße " + prose(3, 30)]
    return list(enumerate(texts, 10)) + [(10, base), (None, base), (None, None)]


# --- near-duplicates -------------------------------------------------------


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    reach = {i: i for i, _ in sets}

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = root(a), root(b)
                reach[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in reach}


@pytest.mark.parametrize("rows", [corpus(), [(i, prose(i // 4, 60) + f" tail{i}") for i in range(80)], []])
def test_near_duplicates_against_brute_force(spark, rows):
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    sizes = sorted((i if i is not None else -1, len(shingle_set(t))) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_near_duplicates_links_at_the_threshold(spark):
    """Chains of documents at about 85 %: none may be lost."""
    r, rows = random.Random(5), []
    for g in range(40):
        words = prose(1000 + g, 120, 5000).split()
        for k in range(6):
            rows.append((len(rows), " ".join(words)))
            at = r.randrange(20, 100)
            words = words[:at] + [f"n{g}_{k}"] + words[at + 1 :]
            at = r.randrange(0, 8)
            words = words[at:] if k % 2 else words
    want = brute_components(rows)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_drop_near_duplicates_keeps_one_of_each(spark):
    rows = corpus()
    left = minhash.drop_near_duplicates(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "extra"]
    want = brute_components(rows)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(want.values()))


# --- repeated byte strings -------------------------------------------------


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1)) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats_corpus():
    shared = prose(50, 60, 900)
    rows = corpus()
    rows += [(100 + k, prose(60 + k, 40) + " " + shared[k * 3 :] + " " + prose(70 + k, 40)) for k in range(6)]
    rows += [(200, shared[:200]), (201, shared[:199]), (202, "x" + shared[:200] + "y"), (203, shared[5:205] + shared[100:320]), (204, "ab" * 500), (205, prose(9, 30) + shared[40:240] + "é" * 150)]
    return rows


@pytest.mark.parametrize("crowd, keys", [(suffix_dedup.CROWD, suffix_dedup.BROADCAST_KEYS), (1, 0), (0, 5)])
def test_remove_repeats_against_brute_force(spark, crowd, keys, monkeypatch):
    """Crowded anchors split or not, counted tables broadcast or shuffled."""
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", keys)
    rows = repeats_corpus()
    got = suffix_dedup.remove_repeats(frame(spark, rows), crowd=crowd).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_remove_repeats_around_a_crowded_passage(spark):
    """One passage in many documents with bytes of their own on either side."""
    r, shared = random.Random(4), prose(50, 90, 900)
    rows = [(k, "".join(r.choice("ab") for _ in range(k % 40)) + shared[: 300 - k % 7] + "".join(r.choice("cd") for _ in range(k % 45))) for k in range(120)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), crowd=3).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_ranges_cover_every_start():
    for reach in (1, 2, 7, 136, 436):
        assert [b for a, e in suffix_dedup.ranges(reach) for b in range(a, e + 1)] == list(range(reach + 1))


def test_remove_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(frame(spark, [(1, None), (2, "")])).select("n_bytes", "n_removed").distinct().collect() == [(0, 0)]


def test_anchors_are_the_same_in_parts(monkeypatch):
    text = prose(4, 3000).encode()
    whole = suffix_dedup.anchors(text)
    monkeypatch.setattr(suffix_dedup, "PART", 777)
    parts = suffix_dedup.anchors(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_column_insertion_orders_suffixes(tmp_path):
    """The transform, order and common prefixes of every column equal a plain sort's."""
    r = random.Random(3)
    pieces = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(40)]
    symbols = np.array([list(p) for p in pieces], np.uint8)
    for column, order, lcp, transform in suffix_dedup.Columns(symbols, np.ones_like(symbols, bool), np.zeros(40, int), f"file://{tmp_path}/columns").rounds():
        suffix = [pieces[i][column:] for i in order]
        assert suffix == sorted(suffix) and lcp[0] == -1
        assert transform.tolist() == [pieces[i][column - 1] + 1 if column else 0 for i in order]
        for k in range(1, 40):
            same = next((n for n, (x, y) in enumerate(zip(suffix[k - 1], suffix[k])) if x != y), 12 - column)
            assert lcp[k] == same
    assert not (tmp_path / "columns").exists()


# --- decontamination -------------------------------------------------------


def contamination(rows, items, window=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    items = [(1, prose(80, 40)), (2, prose(81, 10).upper()), (3, "short item"), (4, "solo"), (5, None), (6, "..."), (12, prose(80, 25)), (7, "a b a b a b a b a b a b")]
    rows = corpus() + [(50, prose(82, 20) + " " + prose(80, 40) + ". " + prose(83, 20)), (51, "A short-item, solo!"), (52, prose(81, 9)), (53, "x " + prose(81, 10)), (54, "a b " * 30), (55, prose(80, 12)[:-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (decontam.BLOCK_BYTES, 60):
        got = decontam.report(frame(spark, rows), bench, block_bytes=block).select(columns).collect()
        assert sorted(map(tuple, got), key=str) == contamination(rows, items)
    left = decontam.clean(frame(spark, rows), bench)
    assert left.columns == ["doc_id", "text", "extra"]
    assert left.count() == sum(not x[-1] for x in contamination(rows, items))
    assert decontam.report(frame(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(frame(spark, []), bench).count() == 0


def longest_match(text, items):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, best = words(text), 0
    for item in map(words, items):
        row = [0] * (len(item) + 1)
        for w in doc:
            row = [0] + [row[j] + 1 if w == x else 0 for j, x in enumerate(item)]
            best = max(best, *row)
    return best


@pytest.mark.parametrize("block_bytes", [100, 8 << 20])
def test_longest_match_against_brute_force(spark, block_bytes):
    leak, other = prose(31, 40), prose(32, 25)
    words = leak.split()
    items = [leak, other, "lone", "three words here", leak + " " + prose(33, 5), ""]
    texts = [f"{prose(k, 30)} {' '.join(words[a:e])} {prose(k + 50, 30)}" for k, (a, e) in enumerate([(0, 40), (0, 40), (3, 33), (5, 15), (33, 40), (35, 38), (0, 9)], 60)]
    texts += [texts[0], leak, leak + " zz " + leak, "a lone word", "three words here", "no match", "", None, " ".join(words[-4:])] + [prose(k, 60) for k in range(80, 95)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: x.longest_match for x in decontam.report(frame(spark, list(enumerate(texts))).coalesce(1), bench, block_bytes=block_bytes).collect()}
    assert got == {i: longest_match(t, items) for i, t in enumerate(texts)} and max(got.values()) >= 40


# --- personal data ---------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes_luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and passes_luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


AWKWARD = [
    "mail a.b@c.example.com, then x@y.z_q@w.v and a@b.c.@d.e @no.one a@b é@x.y",
    "ip 1.2.3.4 and 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 1..2.3.4",
    "card 4539 1488 0343 6467, 4539148803436467 4539-1488-0343-6467 45391488034364671 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5  6 12345678901234567890",
    "phone +1 (017) 555-7713 and +44 20 7946 0958x +123 +1 ((((( +1.2.3.4.5.6.7.8.9.0 1 +49-30-123456-",
    "jo at example dot com; jo (at) example.com; jo[at]mail[dot]example[dot]org; 192[.]168[.]0[.]1; (017) 555-7713; 4539/1488/0343/6467",
    "9" * 3000 + " " + "a" * 3000 + "@",
    "é" * 50 + "x@y.zz" + "1.1.1.1",
    "",
    None,
    "😀 +1 (222) 333-4444 😀 a@b.cd",
]


def test_personal_data_base_spans(spark):
    r = random.Random(8)
    alphabet = "0123456789.@+- ()ab_é\n"
    rows = list(enumerate(AWKWARD + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 160))) for _ in range(400)])) + [(None, "a@b.cd"), (0, AWKWARD[0])]
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), *(sum(s.startswith(k + ":") for s in base_spans(t)) for k in BASE)) for _, t in rows)
    assert sorted((x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in got) == want
    by = {x.doc_id: x.spans for x in got}
    for i, t in rows[:10]:
        assert set(filter(None, base_spans(t))) <= set(by[i].split(",")) | {""}


def test_personal_data_loose_forms(spark):
    plain = [(i, f"text {i} mail jo.{i}@mail{i}.example.com and +1 ({200 + i}) 555-7{100 + i} or 10.0.{i}.7 here") for i in range(60)]
    rows = plain + [(900, AWKWARD[4]), (901, "He sat at home.com at noon. Then 12 of 30 left on 3.4 miles")]
    got = {x.doc_id: x for x in pii.find(frame(spark, rows)).collect()}
    assert got[900].n_added >= 3 and "email:0:21" in got[900].spans
    assert got[901].spans == "" and all(got[i].n_added == 0 for i in range(60))
    clean = {x.doc_id: x.text for x in pii.redact(frame(spark, rows)).collect()}
    assert clean[1] == "text 1 mail [EMAIL] and [PHONE] or [IP] here" and clean[901] == rows[-1][1]


def test_personal_data_context_decides(spark):
    rows = [(i, f"please call +1 ({200 + i}) 555-0{100 + i} today") for i in range(80)] + [(100 + i, f"your order 48-{2000 + i}-{30 + i} shipped") for i in range(80)]
    rows += [(900, "please call 212-555-0100 today"), (901, "your order 212-555-0100 shipped"), (902, "please call 4539/1488/0343/6468 today")]
    got = {x.doc_id: x for x in pii.find(frame(spark, rows)).collect()}
    assert got[900].spans == "phone:12:24" and got[901].spans == "" and got[902].spans == ""
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(80))


def test_threshold_keeps_its_precision():
    x = [0] * len(pii.LEVELS)
    even, pure = pii.Boosted.fit([(x, aside, 6.0, 4.0) for aside in (True, False)]), pii.Boosted.fit([(x, aside, 6.0, 0.0) for aside in (True, False)])
    assert even.probability(x) < even.threshold and pure.probability(x) >= pure.threshold


def test_luhn(spark):
    rows = spark.createDataFrame([("4539148803436467",), ("4539148803436468",), ("0",)], "d string")
    assert [x[0] for x in rows.select(pii.luhn(F.col("d"))).collect()] == [True, False, True]
