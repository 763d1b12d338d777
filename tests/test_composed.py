"""Windows composed from stretches against windows encoded one by one."""

import time

import numpy as np
import pytest

from strandlake.functions import dna
from strandlake.operators import encode
from strandlake.operators.encode import Encoder, Rope
from strandlake.plans import mapping


def text(n, seed=0):
    return "".join(np.array(list("ACGT"))[np.random.default_rng(seed).integers(0, 4, n)])


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


ROPES = [Rope(50), Rope(50, 3, 1, 3, normalize=1), Rope(61, 4, 2, 3, order="big"), Rope(40, 5, 3, 4, normalize=2), Rope(33, 4, 2, 5, scramble=False, frequencies="whole"), Rope(48, 5, 1, 3, phase=False, zero_g=False), Rope(5, 5)]


@pytest.mark.parametrize("rope", ROPES)
@pytest.mark.parametrize("kstep", [1, 7, 10, 46, 50, 75])
def test_composed_windows_are_those_encoded_one_by_one(rope, kstep):
    s = text(400, rope.k)
    codes = encode._CODE[np.frombuffer(s.encode(), np.uint8)]
    encoder = Encoder(rope)
    starts = range(0, len(s) - rope.k + 1, kstep)
    for strand in (0, 1):
        plain = encoder.histogram([turned(s[a : a + rope.k]) if strand else s[a : a + rope.k] for a in starts])
        got = np.concatenate([h for _, _, h in encoder.composed(codes, kstep, (strand,))])
        assert got.shape == plain.shape and np.allclose(got, plain, atol=1e-9)
    assert list(encoder.composed(codes[: rope.k - 1], kstep)) == []


def test_an_index_has_the_windows_of_both_strands(spark):
    rope = Rope(30, 4, 1, 4)
    records = spark.createDataFrame([(0, ">a", text(4000, 1)), (1, ">b", text(29, 2)), (2, ">c", "acgtNN" * 10), (3, ">d", "")], "rec_id long, head string, seq string")
    plain = {(r["col_id"]): r for r in encode.encode(mapping.index_windows(records, 30, 7), rope, "f64").collect()}
    got = {r["col_id"]: r for r in mapping.build_index(records, rope, 7, "f64").collect()}
    assert got.keys() == plain.keys()
    for i, r in got.items():
        assert (r["rec_id"], r["head"], r["start"], r["strand"]) == tuple(plain[i][c] for c in ("rec_id", "head", "start", "strand"))
        assert np.allclose(r["vec"], plain[i]["vec"], atol=1e-9) and np.allclose(r["norms"], plain[i]["norms"], atol=1e-9)
    assert dna.LETTERS == "ACGT"


def test_overlap_costs_nothing():
    """Both strands of windows that overlap tenfold, at least three times as fast as one by one."""
    rope, kstep = Rope(20_000, 5, 1, 5), 2_000
    s = text(400_000)
    codes, encoder = encode._CODE[np.frombuffer(s.encode(), np.uint8)], Encoder(rope)
    seconds = []
    for _ in range(3):
        began = time.thread_time()
        frags = [s[a : a + rope.k] for a in range(0, len(s) - rope.k + 1, kstep)]
        plain = encoder(frags + [turned(f) for f in frags])[0]
        middle = time.thread_time()
        both = {strand: h for strand, _, h in encoder.composed(codes, kstep)}
        made = np.concatenate([encode.normalized(both[x], 0)[0] for x in (0, 1)]).reshape(len(plain), -1)
        seconds.append((middle - began, time.thread_time() - middle))
    assert np.allclose(np.concatenate((made.real, made.imag), 1), plain, atol=1e-9)
    assert min(a for a, _ in seconds) > 3 * min(b for _, b in seconds), seconds
