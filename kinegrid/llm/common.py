"""Helpers that several operators share: tables, shared storage and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, materialise, shared_dir

__all__ = ["SLICE_BYTES", "U64", "Words", "bound_batches", "discard", "gram", "let", "load", "long", "materialise", "mix", "shared_dir", "slices", "unused"]

U64 = np.uint64
#: Bytes of text that one pass of the array code handles; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch, and the setting that bounds them.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = 0x9E3779B97F4A7C15 | 1


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, in a session that has Spark's default of 64 MB: a batch of whole texts is held several
    times over, by the executor and by its Python worker."""
    if spark.conf.get(_BATCH, None) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, lambdas included."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and their inverses modulo 2^64."""
    if _powers.get("up", np.empty(0)).size < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
        if size > 8 * SLICE_BYTES:  # not kept: a very long text passes once
            up, down = _powers.pop("up"), _powers.pop("down")
            return up, down
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a text column; nulls are empty texts."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, wide, column.offset + len(column) + 1)[column.offset :].astype(np.int64) if offsets is not None else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice: byte ranges, the row of each, and 64-bit hashes of their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        solid = _SOLID[data]
        full = offsets[:-1] < offsets[1:]
        before, after = np.empty_like(solid), np.empty_like(solid)
        if data.size:
            before[1:], after[:-1] = solid[:-1], solid[1:]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        #: words of row i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(offsets.size - 1), np.diff(self.first))
        up, down = _power(data.size)
        total = np.zeros(data.size + 1, U64)
        np.cumsum(((_LOWER[data] if lower else data).astype(U64) + U64(1)) * up[: data.size], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))


def gram(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of each n consecutive entries, in order (len - n + 1 of them, none if there are fewer)."""
    if hashes.size < n:
        return np.empty(0, U64)
    out = np.zeros(hashes.size - n + 1, U64)
    for i in range(n):
        out = (out ^ hashes[i : i + out.size]) * U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return mix(out, salt)


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))
