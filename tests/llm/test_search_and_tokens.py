"""Ranked search, cross-tokenizer alignment and language identification against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from strandlake.llm import alignment

SCHEMA = "doc_id long, text string, score string, term string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


AWKWARD = ["", None, " ", "  two  spaces ", "tab\tand\nline", "a b c", "naïve café über", "日本語 テキスト です", "x▁y", "<|endoftext|> </s> <unk>", "don't we'll I'M", "é combining", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ok", "123456 7,890.12", "a" * 700, "end ", "  odd", "\x1c odd\x1d too \x85 x", "Ünï-cödé_word 1e9"]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.PIECE_BPE}")
    letters = alignment.byte_letters()
    docs, counts = [], Counter()
    for i, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        whole = f" {text}".encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((i, [], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for x in parts:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for k, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((ids_a[k], ids_b[m]))
                m += 1
        counts.update(links)
        ends = [{e for _, e in x} for x in spans]
        groups, at = [], [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            part = []
            for side, ids in enumerate((ids_a, ids_b)):
                first = at[side]
                while at[side] < len(ids) and spans[side][at[side]][1] <= cut:
                    at[side] += 1
                part.append(",".join(map(str, ids[first : at[side]])))
            groups.append("|".join(part))
        docs.append((i, ids_a, ids_b, groups, links))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(
        ((i, len(x), len(y), len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, g, k in docs),
        key=str,
    )


def aligned(df, **options):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(df, **options).collect()), key=str)


def wordy(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "word", "Xyzzy", "naïve", "don't", "42", "re-do,", "日本", "end."]) + r.choice(["", "", "ing", "\n", "s"]) for _ in range(n))


@pytest.mark.parametrize("rows", [[*enumerate(AWKWARD), *((100 + i, wordy(i, 30 + i)) for i in range(30)), (3, "again"), (None, "again"), (None, None), (900, wordy(9, 30_000))], []])
def test_alignment_matches_a_plain_version(spark, rows):
    assert aligned(frame(spark, rows).repartition(3)) == plain_alignment(rows)


def test_alignment_is_the_same_in_small_flushes_with_one_hot_side_id(spark):
    rows = [(i, "the " * 40 + wordy(i, 20)) for i in range(120)]
    expected = plain_alignment(rows)
    assert aligned(frame(spark, rows).repartition(5), flush=300, units=10) == expected


def test_counts_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    rows = [(i, wordy(i, 25)) for i in range(60)]
    assert aligned(frame(spark, rows).repartition(6), flush=100) == plain_alignment(rows)


def test_a_tie_makes_both_pairs_best(spark):
    got = aligned(frame(spark, [(1, "the the")]))
    assert got == plain_alignment([(1, "the the")]) and got[0][5] == got[0][4]


# --- ranked search ---------------------------------------------------------


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranking(docs, queries, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in held:
            norm = 100 - 50 + (50 * c.total() * n) // (total or 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * norm)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, shard string, block int")


def ranking(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


QUERIES = [(1, "the word Xyzzy"), (2, "naïve 日本 42 42"), (3, "nothing here"), (4, ""), (5, None), (2, "words ending"), (None, "don't the"), (7, "THE OF WORDING " * 9)]


@pytest.mark.parametrize("docs", [[*enumerate(AWKWARD), *((100 + i, wordy(i, 5 + i % 40)) for i in range(120)), (105, wordy(5, 30)), (None, "the word"), (None, None), (901, wordy(9, 30_000)), *((1000 + i, "the same copy of a word") for i in range(40))], [(1, None)], []])
def test_ranking_matches_a_plain_version(spark, docs):
    from strandlake.llm import lexical

    assert ranking(lexical.ranked(frame(spark, docs).repartition(3), items(spark, QUERIES), 10)) == plain_ranking(docs, QUERIES, 10)


def test_ranking_is_the_same_for_small_shards_and_blocks(spark, tmp_path):
    from strandlake.llm import lexical

    docs = [(i, wordy(i, 8 + i % 30)) for i in range(200)]
    lexical.build_index(frame(spark, docs).repartition(2), shard_docs=17).write.parquet(str(tmp_path / "ix"))
    index = spark.read.parquet(str(tmp_path / "ix"))
    assert index.filter("kind = 0").count() >= 12
    assert ranking(lexical.search(index, items(spark, QUERIES), 5, block=60)) == plain_ranking(docs, QUERIES, 5)


def test_documents_below_the_threshold_are_not_scored():
    import numpy as np

    from strandlake.llm import lexical

    r = np.random.default_rng(4)
    lists = []
    for share, most in ((0.002, 900), (0.3, 40), (0.5, 30)):
        places = np.flatnonzero(r.random(60_000) < share)
        lists.append((most, places, r.integers(1, most + 1, len(places))))
    ids, null = np.arange(60_000), np.zeros(60_000, bool)
    heap = lexical.Heap(20)
    scored = lexical.wand(lists, ids, null, heap)
    total = np.zeros(60_000, np.int64)
    for _, p, x in lists:
        total[p] += x
    best = np.lexsort((ids, -total))[:20]
    assert heap.ids.tolist() == best.tolist() and heap.scores.tolist() == total[best].tolist()
    assert scored < 0.1 * (total > 0).sum()


# --- language identification -----------------------------------------------

VOCABULARY = {
    "en": "the and of that with have this from they would there which their about people",
    "de": "der und die nicht mit haben diese von sie würde dort welche ihre über menschen",
    "fr": "le et la que avec avoir cette dans ils serait où lequel leur sur gens",
    "es": "el y los que con haber esta desde ellos sería donde cual sus sobre personas",
    "xx": "zzyk qorv wuxi jyyk vrok xoqq yvvu kqiz zuzu wqok jzzi qyxu vvyk oxxo kuqq",
}


def spoken(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(VOCABULARY[lang].split()) for _ in range(n))


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, x, "k") for i, t, x in rows], "doc_id long, text string, lang string, score string")


def identified(df):
    return {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in df.collect()}


def test_languages_of_held_out_documents(spark):
    import zlib

    from strandlake.llm import langid

    langs = list(VOCABULARY)
    rows = [(i, spoken(langs[i % 5], i, 5 + i % 60), langs[i % 5]) for i in range(500)]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 ... 5", "fr"), (1003, spoken("fr", 0, 40_000), None), (1004, spoken("es", 1, 9).upper(), None)]
    got = identified(langid.identify(labelled(spark, rows + odd).repartition(3), sample=200, bits=11))
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 80 and all(got[i][0] for i, _ in held) and sum(got[i][0] for i, _, _ in rows) == len(held)
    assert sum(got[i][1] == x for i, x in held) >= 0.98 * len(held)
    assert [got[i][1] for i in range(1000, 1005)] == ["und", "und", "und", "fr", "es"]
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_held_out_labels_and_other_columns_play_no_part(spark):
    import zlib

    from strandlake.llm import langid

    langs = ["en", "de", "fr", "es"]
    rows = [(i, spoken(langs[i % 4], i, 20), langs[i % 4]) for i in range(200)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    a, b = (identified(langid.identify(labelled(spark, r), sample=100, bits=10)) for r in (rows, wrong))
    assert a == b and {x for _, x, _ in a.values()} == set(langs)


@pytest.mark.parametrize("rows, expected", [([], set()), ([(1, "some text", None)], {"und"}), ([(1, "some text", "en"), (1, "some text", "en"), (None, "text", None), (3, "?", None)], {"en", "und"})])
def test_few_labels(spark, rows, expected):
    from strandlake.llm import langid

    assert {r["lang_pred"] for r in langid.identify(labelled(spark, rows)).collect()} == expected


def test_families():
    from strandlake.llm import langid

    assert langid.family("pt-BR") == langid.family("es") == "romance" and langid.family("EN") == "germanic"
    assert langid.family("tlh") == "=tlh" and langid.family("a", {"f": "a b"}) == "f"


def test_long_texts_have_the_grams_of_their_stretches():
    from strandlake.llm import langid

    text = spoken("fr", 3, 400_000)
    whole, part = langid.grams([text, text[: 1 << 19]])
    assert len(text) > 1 << 20 and abs(langid.shares(whole[None]) - langid.shares(part[None])).sum() < 0.01
