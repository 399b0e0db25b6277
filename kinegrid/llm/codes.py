"""Vector code compression: product codes by Lloyd's rounds in whole numbers, nearest entries found by exponion search.

Components become whole numbers, vectors are cut into equal consecutive parts, and each part position has a codebook of its own.
A part starts at the entry that it had in the round before. With u the distance to that entry, an entry can be as near
or nearer only if it lies within 2 u of it (triangle inequality); so the entry's neighbours are scanned in the order of their
distance from it, and the scan of a part ends at the first beyond. Distances are squared and whole: the test is
4 u^2 >= (distance of the entries)^2, exactly, and ties go to the lower index.

Each round is one pass over a stored table of vectors and their codes, which it replaces. A task emits its vectors and, at its end,
one row for each part, entry and component with the sum and count; what reaches the driver is entries x components rows,
whatever the number of vectors.

Rows: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those of another length than
the commonest (the greatest of equally common ones), and those with a component of LARGE or more, whose distances would not fit
64 bits; a length that the parts do not divide is an error; rows that repeat an id are rows of their own, in the order of their
components where the first entries are chosen; rows without an id are coded, but are no first entries; with fewer rows than
entries the codebooks are smaller; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, long, materialise

#: Magnitude of a component (before it is scaled) from which on a row is dropped.
LARGE = 1 << 14


class Exponion:
    """The codebook of one part position with, for each entry, the others in the order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance) of each part, and how many distances that took; `start` are entries to begin at."""
        best, least, asked = start.copy(), ((parts - self.entries[start]) ** 2).sum(axis=1), len(parts)
        for entry in range(len(self.entries)):
            some = np.flatnonzero(start == entry)
            radius = 4 * least[some]
            for other, apart in zip(self.order[entry], self.apart[entry], strict=True):
                near = radius >= apart
                some, radius = some[near], radius[near]
                if not some.size:
                    break
                if other == entry:
                    continue
                asked += some.size
                distance = ((parts[some] - self.entries[other]) ** 2).sum(axis=1)
                better = (distance < least[some]) | ((distance == least[some]) & (other < best[some]))
                best[some[better]], least[some[better]] = other, distance[better]
        return best, least, asked


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, values (whole numbers) of the usable rows."""
    x = F.col("embedding").cast("array<double>")
    good = F.size(x) > 0
    good = good & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGE * 4096 / scale))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).where(good).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("values"))
    lengths = rows.groupBy(F.size("values").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("values") == (lengths[0] if lengths else 0))


def coded(rows: DataFrame, books: list[np.ndarray], parts: int) -> DataFrame:
    """`rows` (vec_id, label, values, code) with their new codes and errors, and rows of sums (entry, component, total, count)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    names = ["vec_id", "label", "values", "code", "error", "entry", "component", "total", "count"]
    kinds = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Exponion(b) for b in shared.value]
        k, width = shared.value[0].shape
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        empty = None
        for batch in batches:
            n = batch.num_rows
            if empty is None:
                empty = batch.slice(0, 0)
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(n, parts, width).astype(np.int64)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, search in enumerate(searches):
                found, distance, _ = search.nearest(values[:, p], before[:, p].astype(np.int64))
                code[:, p] = found
                error += distance
                np.add.at(total[p], found, values[:, p])
                count[p] += np.bincount(found, minlength=k)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([x.tobytes() for x in code], pa.binary()), long(error), *(none,) * 4], names=names)
        if empty is not None:
            p, e, c = (x.ravel() for x in np.indices(total.shape))
            none = pa.nulls(p.size)
            yield pa.RecordBatch.from_arrays([*(none.cast(empty.schema.field(i).type) for i in range(4)), none.cast(pa.int64()), long(e), long(p * width + c), long(total.ravel()), long(np.repeat(count.ravel(), width))], names=names)

    return rows.select("vec_id", "label", "values", "code").mapInArrow(run, f"vec_id long, label {kinds}, values binary, code binary, error long, entry long, component long, total long, count long")


def moved(books: list[np.ndarray], found: DataFrame) -> list[np.ndarray]:
    """The codebooks with each entry at the floored mean of its parts; those without a part stay."""
    width = books[0].shape[1]
    out = [b.copy() for b in books]
    sums = found.where("entry is not null").groupBy("entry", "component").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    for entry, component, total, count in sums.where("count > 0").collect():  # a row for each entry and component
        out[component // width][entry, component % width] = total // count
    return out


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code (a byte for each part), error (squared distance to the entries)), and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    bound_batches(vectors.sparkSession)
    whole = materialise(whole_numbers(vectors, scale), "whole")
    first = whole.where("vec_id is not null").orderBy("vec_id", "values").limit(entries).select("values").collect()
    if not first:
        return whole.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), []
    start = np.array([r[0] for r in first], np.int64)
    if start.shape[1] % parts:
        raise ValueError(f"{start.shape[1]} components cannot be cut into {parts} equal parts")
    books = list(np.ascontiguousarray(x) for x in np.split(start, parts, axis=1))
    rows, spent = packed(whole, parts), whole
    for r in range(rounds + 1):
        found = materialise(coded(rows, books, parts), f"codes{r}")
        discard(spent)
        if r < rounds:
            books = moved(books, found)
        rows, spent = found.where("entry is null"), found
    return rows.select("vec_id", "label", "code", "error"), books


def packed(whole: DataFrame, parts: int) -> DataFrame:
    """With values as 4-byte numbers and the first entry as the code of every part."""
    kinds = whole.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([bytes(parts)] * batch.num_rows, pa.binary())], names=["vec_id", "label", "values", "code"])

    return whole.select("vec_id", "label", "values").mapInArrow(run, f"vec_id long, label {kinds}, values binary, code binary")


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def digest(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256."""
    rows, books = compress(vectors, parts, entries, rounds, scale)
    labels = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined: Column = F.col("label").eqNullSafe(F.col("of"))
    return rows.join(labels, joined).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
