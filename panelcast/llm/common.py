"""Shared helpers: reading tables, hashing the words of Arrow text columns without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

# bytes that separate words: [\x20\x09-\x0D]
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
# A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2_000_000
# where workers also hold a model or lists of hashes
SMALL_SLICE_BYTES = 500_000
# a proven bound of 16 MB
BROADCAST_IDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def matching(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``df`` semi- or anti-joined with ``ids`` (one column ``on``), which is written first and counted.

    Up to ``BROADCAST_IDS`` ids go to every task, so that long rows of ``df`` need not be shuffled;
    beyond that the join shuffles both sides.
    """
    ids = cut_lineage(ids.distinct())
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def word_count(text: Column) -> Column:
    """Number of words of a text; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of consecutive runs of rows, each of about ``limit`` bytes
    (one row at least). A null is a row without bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield first, raw[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a slice, and the number of words before each row's end."""
    inside = ~SEPARATOR[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    if len(at) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    up, down = powers(len(data))
    values = LOWER[data].astype(np.uint64)
    values += np.uint64(1)
    values *= inside
    values *= up
    return mix(np.add.reduceat(values, at) * down[at]), np.searchsorted(at, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
