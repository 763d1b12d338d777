"""Helpers shared by the training-data operators: the shared folder, batches, byte kernels."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded_batches, fresh_path  # noqa: F401 - one name for all operators here

U64 = np.uint64
#: Fixed odd multipliers and shifts of the 64-bit finaliser (splitmix64).
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
WORD_BASE = 0x9E3779B97F4A7C15 | 1
#: Added to what is hashed; bytes above which a word is hashed by digest.
SALT, LONG = U64(0xD6E8FEB86659FD93), 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """A folder of its own below the shared folder, for tables that cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, fresh_path(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
        """The saved table and ``measures`` of its rows, taken while it is written."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        return self.save(df.observe(seen, *measures), name), seen.get

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that no table has (names count alike in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path in any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of an array of uint64."""
    h = h ^ (h >> U64(30))
    h = h * MIX_A
    h = h ^ (h >> U64(27))
    h = h * MIX_B
    return h ^ (h >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int = WORD_BASE):
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, U64), np.full(size - 1, b, U64)))) for b in (self.base, self.inverse))
        return self.up, self.down


POWERS = Powers()
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words for the alphanumeric rule: all ASCII but digits and letters.
NONALNUM = np.zeros(256, bool)
NONALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def word_spans(buf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes that are no gap."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~gap[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, the same wherever it stands.

    Eight bytes at a time go through the finaliser, which is no polynomial: no
    family of texts collides by its form. Words of more than LONG bytes are
    hashed by digest.
    """
    n = ends - starts
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))
    out = mix(n.astype(U64) * SALT)
    at = np.flatnonzero((n > 0) & (n <= LONG))
    for lane in range(LONG // 8):
        at = at[n[at] > 8 * lane]
        if not len(at):
            break
        value = eight[starts[at] + 8 * lane].view(U64).ravel()
        short = U64(8) * np.minimum(n[at] - 8 * lane, 8).astype(U64)
        value = np.where(short < U64(64), value & ((U64(1) << np.minimum(short, U64(63))) - U64(1)), value)
        out[at] = mix(out[at] * MIX_B + mix(value ^ SALT) + U64(lane))
    for i in np.flatnonzero(n > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [x or b"" for x in a.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 1 << 20):
    """Index ranges of neighbouring texts of about ``most`` bytes together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_places(texts: list[bytes], gap: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The ASCII-lower-cased texts in one, starts and ends of their words there, and where each text's words begin (len + 1)."""
    whole = b" ".join(texts).lower() + b" "
    starts, ends = word_spans(np.frombuffer(whole, np.uint8), gap)
    return whole, starts, ends, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def words_of(texts: list[bytes], gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of texts, and where each text's begin (len + 1)."""
    whole, starts, ends, offsets = word_places(texts, gap)
    return word_hashes(np.frombuffer(whole, np.uint8), starts, ends), offsets


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
