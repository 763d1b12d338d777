"""Joins of places and stretches on one line: equal bins, then the exact condition.

A place lies in a bin of the margin's width, and what it may meet in that bin or
one of its neighbours. A name that all rows share is then many keys and not one.
A bin that holds very many rows is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the left side in one bin above which the bin is split.
HOT = 200_000


def near(left: DataFrame, right: DataFrame, by: list[str], at: str, to: str, margin: int, hot: int = HOT) -> DataFrame:
    """Pairs of rows of equal ``by`` whose places ``at`` (left) and ``to`` (right) lie at most ``margin`` apart.

    The result has the columns of both sides, ``by`` once; other names must
    differ. Null places and keys meet nothing; a negative margin gives nothing.
    Candidates of a place are those of three bins of margin + 1 places each, of
    which the result holds up to two thirds where places lie evenly.
    """
    width = max(0, margin) + 1
    binned = lambda c: F.floor(F.col(c) / width).cast("long")
    x = left.withColumn("_bin", binned(at))
    y = right.withColumn("_bin", F.explode(F.array(*(binned(to) + i for i in (-1, 0, 1)))))
    return _dealt(x, y, [*by, "_bin"], hot).filter(F.abs(F.col(at) - F.col(to)) <= margin)


def overlapping(left: DataFrame, right: DataFrame, by: list[str], first: tuple[str, str], last: tuple[str, str], width: int, hot: int = HOT) -> DataFrame:
    """Pairs of rows of equal ``by`` whose stretches share a place; a pair once, however many bins it shares.

    ``first`` and ``last`` name the bounds (both included) of left and right.
    ``width`` is the bins' size: about the usual length of a stretch. Stretches
    with a null bound, or that end before they begin, meet nothing.
    """
    each = lambda t, a, e: t.filter(F.col(a) <= F.col(e)).withColumn("_bin", F.explode(F.sequence(_bin(a, width), _bin(e, width))))
    x, y = each(left, first[0], last[0]), each(right, first[1], last[1])
    share = (F.col(first[0]) <= F.col(last[1])) & (F.col(first[1]) <= F.col(last[0]))
    # Of the bins that a pair shares, only that of its first common place gives it.
    once = F.col("_bin") == F.floor(F.greatest(first[0], first[1]) / width)
    return _dealt(x, y, [*by, "_bin"], hot, keep=share & once)


def _bin(c: str, width: int) -> Column:
    return F.floor(F.col(c) / width).cast("long")


def _dealt(x: DataFrame, y: DataFrame, keys: list[str], hot: int, keep: Column | None = None) -> DataFrame:
    """The join on ``keys``; keys of more than ``hot`` rows on the left are split into shares, which the right rows go to all of."""
    sizes = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
    shares = sizes.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_shares"))
    x = x.join(shares, keys, "left").withColumn("_share", F.pmod(F.xxhash64(*x.columns), F.coalesce("_shares", F.lit(1)))).drop("_shares")
    y = y.join(shares, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)).cast("long") - 1))).drop("_shares")
    joined = x.withColumn("_share", F.col("_share").cast("long")).join(y, [*keys, "_share"])
    return (joined.filter(keep) if keep is not None else joined).drop("_bin", "_share")
