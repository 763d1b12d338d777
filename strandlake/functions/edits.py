"""Edit distances of long texts: all rows of a column of the table at once, as the bits of one whole number.

The built-in function fills every cell of the table of a pair. Here a column of
the table is two bit vectors (where the distance grows, where it falls), and a
letter changes them in a dozen operations on whole words. For texts that look
like copies only a band around the diagonal is kept, and it is widened until the
distance lies within it. Else all rows are kept, and the longer text is the one
that stands for the rows: there are as many steps as the shorter has letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half width of the first band, and what it is multiplied by.
BAND, WIDEN = 63, 4
#: Places of the shorter text whose ``GRAM`` letters are sought in the longer: a band is tried if half of them are there. The result does not depend on it.
PLACES, GRAM = 8, 24


def distance(a: str, b: str, band: int = BAND) -> int:
    """Levenshtein distance, in code points."""
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return len(b)
    more = len(b) - len(a)
    band = max(band, more)
    if 4 * band < len(a) and _alike(a, b):
        where = _places(a)
        while 4 * band < len(a):
            found = _banded(where, len(a), b, band)
            # A way that leaves the band comes back to the last diagonal at no less than this.
            if found <= 2 * band + 1 - more:
                return found
            band *= WIDEN
    return _whole(_places(b), len(b), a)


def _places(a: str) -> dict[str, int]:
    """The places of each letter, as bits."""
    letters, turned = set(a), a[::-1]
    if len(letters) > 32:
        where: dict[str, int] = {}
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        return where
    return {c: int(turned.translate({ord(x): "01"[x == c] for x in letters}), 2) for c in letters}


def _alike(a: str, b: str) -> bool:
    at = [i * (len(a) - GRAM) // (PLACES - 1) for i in range(PLACES)] if len(a) >= GRAM else [0]
    return 2 * sum(a[i : i + GRAM] in b for i in at) >= len(at)


def _whole(where: dict[str, int], m: int, b: str) -> int:
    full = (1 << m) - 1
    up, down = full, 0
    get = where.get
    for c in b:
        same = get(c, 0)
        d = ((same & up) + up ^ up | same | down) & full
        grow, fall = (down | full ^ (d | up)) << 1 | 1, (d & up) << 1
        up, down = (fall | ~(d | grow)) & full, d & grow
    # Down the last column, from the cell above its first row.
    return len(b) + up.bit_count() - down.bit_count()


def _banded(where: dict[str, int], m: int, b: str, band: int) -> int:
    """The distance if it is ``band`` at most, else something larger. ``b`` is no shorter than the m letters of ``where``.

    Bit i of column j stands for row j - band + i; the band moves down a row
    with each column, so vectors are shifted by one place against ``_whole``.
    """
    n, width = len(b), 2 * band + 1
    full, top = (1 << width) - 1, 1 << 2 * band
    # Column 0 grows by one with each row; there are no rows in the band's upper half.
    up, down, total = full & ~((1 << band) - 1), 0, min(band, m)
    get = where.get
    for j in range(n):
        # Rows j + 1 - band .. j + 1 + band of the next column, from 1.
        shift = j - band
        bits = get(b[j], 0)
        same = (bits >> shift if shift >= 0 else bits << -shift) & full
        x = same | down
        d = ((same & up) + up ^ up | x) & full
        grow, fall = down | full & ~(d | up), d & up
        if j + band < m:
            # The distance at the band's lower edge, along its diagonal.
            if not d & top:
                total += 1
        else:
            # The edge has passed the last row: follow the last row to the right.
            row = 1 << m - 1 - shift if m - 1 - shift >= 0 else 0
            if grow & row:
                total += 1
            elif fall & row:
                total -= 1
        up, down = fall | full & ~(d >> 1 | grow), d >> 1 & grow
    return total


def edits(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of two columns of text; null with null. For long texts: short ones are better off with the built-in function."""

    @F.pandas_udf("long")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x.where(x.notna(), None), y.where(y.notna(), None))], dtype="Int64")

    return run(a, b)


#: Letters from which on the built-in function's table costs more than handing the texts over.
LONG = 1000


def edits_of(a: Column | str, b: Column | str, length: int) -> Column:
    """Levenshtein distance of texts of about ``length`` letters, by what is faster at that length; both give the same."""
    return edits(a, b) if length >= LONG else F.levenshtein(a, b)
