"""Column functions on DNA text and codes. All but ``dna_hash_of`` are JVM-side expressions.

A sequence is a string of letters; its codes are an array with A=0, C=1, G=2,
T=3. ``acgt`` gives every other character the letter G and keeps its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"
#: The multiplier of the scramble, and its 32-bit wrap.
GOLDEN, WRAP = 2654435761, 4294967295


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def acgt(seq: Column | str) -> Column:
    """Upper-case ACGT; anything else is G at the same place."""
    return F.upper(F.regexp_replace(col(seq), "[^ACGTacgt]", "G"))


def acgt_or_a(seq: Column | str) -> Column:
    """As ``acgt``, with A for what is no base."""
    return F.upper(F.regexp_replace(col(seq), "[^ACGTacgt]", "A"))


def acgt_only(seq: Column | str) -> Column:
    """N is G; other characters that are no base are left out."""
    return F.translate(F.upper(F.regexp_replace(col(seq), "[^ACGTNacgtn]", "")), "N", "G")


def iupac_to_g(seq: Column | str) -> Column:
    """The ambiguity letters B K M R S W Y as G; the rest stays."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.translate(col(seq), lower, lower.upper()), "BKMRSWY", "GGGGGGG")


def codes(seq: Column | str) -> Column:
    """array<int> of a sequence of ACGT letters."""
    s = col(seq)
    return F.when(F.length(s) > 0, F.transform(F.split(F.translate(s, LETTERS, "0123"), ""), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def letters(code: Column | str) -> Column:
    """The letters of an array of codes."""
    return F.translate(F.array_join(col(code), ""), "0123", LETTERS)


def has_bad(seq: Column | str) -> Column:
    """True if some character is no base."""
    return col(seq).rlike("[^ACGTacgt]")


def strict(seq: Column | str) -> Column:
    """The sequence if it is upper-case ACGT throughout; an error otherwise."""
    s = col(seq)
    return F.when(s.rlike("^[ACGT]*$"), s).otherwise(F.raise_error(F.concat(F.lit("not ACGT: "), F.substring(s, 1, 40))).cast("string"))


def n_bad(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(col(seq), "[ACGTacgt]", ""))


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), LETTERS, "TGCA"))


def revcomp_codes(code: Column | str) -> Column:
    return F.reverse(F.transform(col(code), lambda c: 3 - c))


def smer_little(smer: Column | str) -> Column:
    """Number of an s-mer, first base in the lowest bits."""
    return smer_big(F.reverse(col(smer)))


def smer_big(smer: Column | str) -> Column:
    """Number of an s-mer, first base in the highest bits."""
    return F.conv(F.translate(col(smer), LETTERS, "0123"), 4, 10).cast("long")


def scramble(smer: Column | str, c: int) -> Column:
    """Folds an s-mer's number into 0 .. 4**c - 1: the low bits, crossed with the upper ones times the golden ratio."""
    mask, s = 4**c - 1, col(smer)
    return s.bitwiseAND(mask).bitwiseXOR((F.shiftrightunsigned(s, 2 * c) * F.lit(GOLDEN)).bitwiseAND(WRAP).bitwiseAND(mask))


def pack_words(code: Column | str) -> Column:
    """array<long> of 32-bit words, 16 bases each, base j in bits 2 * (j % 16); zeros at the end."""
    word = lambda c, w: F.aggregate(F.reverse(F.slice(c, w * 16 + 1, F.lit(16))), F.lit(0).cast("long"), lambda acc, x: acc * 4 + x)
    # The codes are bound once: an expression inside a lambda would be computed again for every word.
    return F.transform(F.array(col(code)), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(c) - 1) / 16).cast("int"), F.lit(0))), lambda w: word(c, w)))[0]


def unpack_words(words: Column | str, n: Column | int) -> Column:
    """The first ``n`` codes of packed words."""
    return F.slice(F.flatten(F.transform(col(words), lambda w: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (F.call_function("shiftrightunsigned", w, (2 * j).cast("int")) % 4).cast("int")))), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def pack_reversed(code: Column | str) -> Column:
    """Packed words of the bases in reverse order."""
    return pack_words(F.reverse(col(code)))


def record_name(head: Column | str) -> Column:
    """A header's first token, without its ``>``."""
    return F.regexp_extract(col(head), r"^>?\s*(\S+)", 1)


def provenance(head: Column | str) -> Column:
    """struct<id, src, start, len> of a read's header; null if it has neither form.

    ``>read_<i> start=<1-based> len=<k> src=<name>`` or
    ``>record:<0-based>:<true|false>[#n]``, whose start is made 1-based.
    """
    h = col(head)
    fields = F.regexp_extract(h, r"^(.*?) src=", 1)
    number = lambda s: F.try_to_number(F.nullif(s, F.lit("")), F.lit("999999999999999999")).cast("long")
    whole = lambda name: number(F.regexp_extract(fields, rf"\s{name}=([0-9]+)(?:\s|$)", 1))
    sample = F.struct(F.regexp_extract(h, r"^(\S+)", 1).alias("id"), F.regexp_extract(h, r"(?s)^.*? src=(.*)$", 1).alias("src"), whole("start").alias("start"), whole("len").alias("len"))
    colon = F.struct(h.alias("id"), F.regexp_extract(h, "^>([^:]*):", 1).alias("src"), (number(F.regexp_extract(h, "^>[^:]*:([0-9]+):", 1)) + 1).alias("start"), F.lit(None).cast("long").alias("len"))
    is_sample = h.startswith(">read_")
    good_sample = h.contains(" src=") & whole("start").isNotNull() & whole("len").isNotNull() & fields.rlike(r"^\S+(\s+[^\s=]+=\S*)+$")
    return F.when(is_sample & good_sample, sample).when(~is_sample & h.rlike("^>[^:]*:[0-9]+:(true|false)(#[^:]*)?$"), colon)


def loose_provenance(head: Column | str) -> Column:
    """struct<id, src, start, len> of a header's name=value fields in any order, ``id=`` among them; null if it has neither a source nor a start.

    The id is the first token unless a field gives one. A header without fields
    whose id is ``record:<0-based>:<strand>`` has its place from that.
    """
    tokens = F.filter(F.split(F.regexp_replace(col(head), "^>", ""), " +"), lambda t: t != "")
    last = lambda name: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t: t.startswith(f"{name}=")), lambda t: F.substring(t, len(name) + 2, 1 << 30))), -1)
    whole = lambda c: F.when(c.rlike("^[+-]?[0-9]{1,18}$"), c).cast("long")
    id_ = F.coalesce(last("id"), F.get(tokens, F.lit(0)))
    src, start, len_ = F.coalesce(last("src"), F.lit("")), F.coalesce(whole(last("start")), F.lit(0)), F.coalesce(whole(last("len")), F.lit(0))
    parts = F.split(id_, ":")
    colon = (start == 0) & (src == "") & id_.contains(":")
    place = F.when((F.size(parts) == 3) & parts[1].rlike("^[+-]?[0-9]{1,18}$"), F.struct(id_.alias("id"), parts[0].alias("src"), (parts[1].cast("long") + 1).alias("start"), len_.alias("len")))
    return F.when(colon, place).when((start > 0) | (src != ""), F.struct(id_.alias("id"), src.alias("src"), start.alias("start"), len_.alias("len")))


def read_head(i: Column, start: Column, k: int, head: Column) -> Column:
    """Provenance header of a sampled read."""
    return F.format_string(f">read_%d start=%d len={k} src=%s", i, start, record_name(head))


def sample_parameters(path: Column | str) -> Column:
    """struct<n, k, err, seed, random, withn> that a sample's file name records."""
    p = col(path)
    part = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    return F.struct(part(r"_n(\d+)_").cast("long").alias("n"), part(r"_k(\d+)_").cast("long").alias("k"), part(r"_e([0-9.]+?)(?:_|\.fasta)").cast("double").alias("err"), part(r"_s(\d+)(?:_|\.)").cast("long").alias("seed"), p.contains("_drandom").alias("random"), p.contains("_withn").alias("withn"))


def cut(seq: Column | str, starts: Column, n: Column | int) -> Column:
    """Substrings of ``n`` characters at many places (from 1) of one sequence.

    Text of one byte a character is cut as bytes, where a place is found at
    once; other text as an array of its characters. Only text with characters
    that Java holds as two is walked to each place.
    """
    s = col(seq)
    n = n if isinstance(n, Column) else F.lit(n)
    plain = F.transform(F.array(s.cast("binary")), lambda b: F.transform(starts, lambda p: F.substring(b, p, n).cast("string")))[0]
    listed = F.transform(F.array(F.split(s, "")), lambda a: F.transform(starts, lambda p: F.array_join(F.slice(a, p, n), "")))[0]
    walked = F.transform(starts, lambda p: F.substring(s, p, n))
    return F.when(F.octet_length(s) == F.length(s), plain).when(~s.rlike("[\\x{10000}-\\x{10FFFF}]"), listed).otherwise(walked)


def grams(seq: Column | str, n: int) -> Column:
    """All substrings of length ``n``, in order."""
    s = col(seq)
    return F.when(F.length(s) >= n, cut(s, F.sequence(F.lit(1), F.length(s) - n + 1), n)).otherwise(F.array().cast("array<string>"))


def shared_grams(a: Column | str, b: Column | str, n: int = 16) -> Column:
    """How many n-gram places of ``b`` hold an n-gram of ``a``."""
    known = F.array_distinct(grams(a, n))
    return F.size(F.filter(grams(b, n), lambda g: F.array_contains(known, g)))


def edit_rate(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance over the longer length; two empty texts are equal."""
    return F.when(F.greatest(F.length(a), F.length(b)) > 0, F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def capped_edits(a: Column | str, b: Column | str, most: int) -> Column:
    """Levenshtein distance up to ``most``; -1 beyond it."""
    return F.levenshtein(col(a), col(b), most)


def block_edit_rates(a: Column | str, b: Column | str, size: int = 1000) -> Column:
    """The edit rate of each pair of blocks of ``size`` characters at the same place; as many as the shorter text has whole or begun."""
    a, b = col(a), col(b)
    n = F.ceil(F.least(F.length(a), F.length(b)) / size).cast("int")
    rate = lambda i: edit_rate(F.substring(a, i * size + 1, F.lit(size)), F.substring(b, i * size + 1, F.lit(size)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), rate)).otherwise(F.array().cast("array<double>"))


def edit_rate_plausible(distance: Column, k: Column | int, err: Column | float) -> Column:
    """Whether a read of ``k`` bases mutated at ``err`` may have this distance: half the rate to the rate and one base."""
    return (distance / k >= 0.5 * err) & (distance / k <= err + 1 / k)


def dna_hash(code: Column | str, size: int = 8) -> Column:
    """Hex of the blocks of ``size`` codes added modulo 256; a shorter sequence is padded with 255."""
    c = col(code)
    sums = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.aggregate(F.filter(c, lambda x, i: i % size == j), F.lit(0), lambda a, x: (a + x) % 256))
    padded = F.concat(c, F.array_repeat(F.lit(255), F.lit(size) - F.size(c)))
    return F.lower(F.array_join(F.transform(F.when(F.size(c) < size, padded).otherwise(sums), lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def dna_hash_of(seq: Column | str, size: int = 8) -> Column:
    """As ``dna_hash`` of a text of ACGT letters, whose codes are added in place: no array of codes is made, nor one pass over it for each block."""
    code = np.zeros(256, np.uint8)
    code[list(LETTERS.encode())] = range(4)

    def of(text: str | None) -> str | None:
        if text is None:
            return None
        held = code[np.frombuffer(text.encode("ascii"), np.uint8)]
        if len(held) < size:
            return (held.tobytes() + b"\xff" * (size - len(held))).hex()
        held = np.concatenate((held, np.zeros(-len(held) % size, np.uint8)))
        return held.reshape(-1, size).sum(0, np.int64).astype(np.uint8).tobytes().hex()

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array((of(text.as_py()) for text in part), pa.string())

    return F.arrow_udf(run, "string")(col(seq))


def comma(x: Column | str) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(col(x).cast("long"), 0)


def similarity_bin(score: Column | str) -> Column:
    """1 .. 34: sixteenths from -1 to 1, with one bin below and one above; NaN has none."""
    s = col(score)
    return F.when(~F.isnan(s), F.least(F.greatest(F.greatest(F.least((s + 1) * 16, F.lit(99.0)), F.lit(-99.0)).cast("int") + 2, F.lit(1)), F.lit(34)))


def hits_bucket(n: Column | str) -> Column:
    """1 .. 6 for 0, 1, 2-10, 11-100, 101-1000 and more hits."""
    n = col(n)
    return F.when(n == 0, 1).when(n == 1, 2).when(n <= 10, 3).when(n <= 100, 4).when(n <= 1000, 5).otherwise(6)


#: The lower edges of run-length classes.
RUN_EDGES = (1, 2, 3, 11, 101, 1001, 10001, 100001, 1000001)


def run_class(length: Column | str) -> Column:
    """1 .. 9: the class of a run's length."""
    return sum(((col(length) >= e).cast("int") for e in RUN_EDGES), F.lit(0))


def barcode(seq: Column | str, size: int = 600) -> Column:
    """A barcode made uniform: gaps out, no base is A, cut or filled with G to ``size``."""
    return F.rpad(F.substring(acgt_or_a(F.replace(col(seq), F.lit("-"), F.lit(""))), 1, size), size, "G")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays; null if their sizes differ."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))


def rope_inner(a: Column | str, b: Column | str) -> Column:
    """struct<re, im, modulus> of the complex inner product of split vectors [re.., im..]."""
    a, b = col(a), col(b)
    half = F.floor(F.size(a) / 2).cast("int")
    left, right = F.slice(a, F.lit(1), half), F.slice(a, half + 1, half)
    bl, br = F.slice(b, F.lit(1), half), F.slice(b, half + 1, half)
    re, im = dot(a, b), dot(left, br) - dot(right, bl)
    return F.struct(re.alias("re"), im.alias("im"), F.sqrt(re * re + im * im).alias("modulus"))


def concentration(vec: Column | str) -> Column:
    """struct<top, effective, bits, live> of the share of energy by bin of a split vector."""
    v = col(vec)
    half = F.floor(F.size(v) / 2).cast("int")
    energy = F.zip_with(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half), lambda a, b: a.cast("double") * a + b.cast("double") * b)
    total = F.aggregate(energy, F.lit(0.0), lambda s, x: s + x)
    p = F.transform(energy, lambda e: e / total)
    return F.struct(
        F.array_max(p).alias("top"),
        (1 / F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x)).alias("effective"),
        F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x * F.log2(x)).alias("bits"),
        F.size(F.filter(p, lambda x: x > 1e-6)).alias("live"),
    )


def interpolate(curve: list[tuple[float, float]], x: Column | str) -> Column:
    """Piecewise linear through (x, y), carried on past both ends, never below 1."""
    points = sorted(curve)
    x = col(x)
    segments = [(x0, y0, (y1 - y0) / (x1 - x0)) for (x0, y0), (x1, y1) in zip(points, points[1:]) if x1 > x0]
    if not segments:
        return F.lit(max(1.0, points[0][1] if points else 1.0))
    line = lambda s: F.lit(s[1]) + (x - s[0]) * s[2]
    out = reduce(lambda rest, s: F.when(x < s[1], line(s[0])).otherwise(rest), reversed([(a, b[0]) for a, b in zip(segments, segments[1:])]), line(segments[-1]))
    return F.greatest(F.lit(1.0), out)
