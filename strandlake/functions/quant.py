"""The 8-bit float grid e4m3 (4 exponent and 3 fraction bits, no infinity), on ordinary floats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: largest finite number, least exponent, fraction bits.
TOP, LEAST_EXPONENT, FRACTION = 448.0, -6, 3


def e4m3(x: Column | str) -> Column:
    """The nearest number of the grid, halves to even, clamped to its ends."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    e = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(LEAST_EXPONENT))
    step = F.pow(F.lit(2.0), e - FRACTION)
    return F.when(x == 0, 0.0).otherwise(F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.rint(x / step) * step)))


def e4m3_array(v: Column | str) -> Column:
    return F.transform(v, e4m3)


def e4m3_numpy(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    with np.errstate(divide="ignore"):
        e = np.maximum(np.floor(np.log2(np.abs(x))), LEAST_EXPONENT)
    step = np.exp2(np.where(np.isfinite(e), e, 0) - FRACTION)
    return np.clip(np.rint(x / step) * step, -TOP, TOP)


def split_complex(re: Column | str, im: Column | str) -> tuple[Column, Column]:
    """The two real vectors whose products with [re, im] are a complex inner product's parts."""
    re, im = (F.col(c) if isinstance(c, str) else c for c in (re, im))
    return F.concat(re, im), F.concat(im, F.transform(re, lambda x: -x))


def stacked(a: Column | str, b: Column | str) -> Column:
    """Two split vectors one after the other, as one split vector: both real parts, then both imaginary ones."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    half = lambda v: F.floor(F.size(v) / 2).cast("int")
    return F.concat(F.slice(a, F.lit(1), half(a)), F.slice(b, F.lit(1), half(b)), F.slice(a, half(a) + 1, half(a)), F.slice(b, half(b) + 1, half(b)))


def side_by_side(a: DataFrame, b: DataFrame, key: str = "col_id") -> DataFrame:
    """The columns (key, vec) of two split matrices as one matrix; the second's keys go on after the first's largest."""
    last = a.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("last"))
    return a.select(F.col(key).cast("long").alias(key), "vec").unionByName(b.join(F.broadcast(last)).select((F.col(key) + F.col("last")).alias(key), "vec"))
