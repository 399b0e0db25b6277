"""Substring dedup by super-k-mers of words.

A window is `size` consecutive words of a text. Its minimiser is the least hash of its runs of MINIMISER words; consecutive
windows with one minimiser make a super-k-mer, which travels as one packed string of its words. Three steps find the
windows that start earlier elsewhere:

1. Minimisers are counted; only those that occur again can be in a repeated window.
2. Super-k-mers of such minimisers are packed. Equal packed strings (by a 128-bit digest of their bytes) are one entry with
   its first place: in all other places each of its windows starts earlier. Copies, however many, collapse here.
3. The distinct packed strings of a minimiser's bucket are cut into windows, and sorting these counts them exactly. Buckets
   with one packed string that holds its minimiser once have no further repeated window, and their strings stay behind.

Windows are told apart by two independent 64-bit hashes of their words.

Rows: a null text has no words; texts are read whole; a text with fewer words than a window keeps all of them; rows that
repeat an id and a text have one result, which each gets; rows that repeat an id with other texts are texts of their own, in
the order of their hashes; rows without an id keep all their words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bound_batches, discard, gram, long, materialise, slices

#: Words of a minimiser.
MINIMISER = 10


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive entries."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:]) if x.size > done else x[:0]
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest and x.size > rest else x if not rest else x[:0]


def runs(found: Words, size: int) -> tuple[np.ndarray, ...]:
    """(minimiser, row, first window in words of the slice, number of windows, whether the minimiser occurs once) of the
    super-k-mers of a slice."""
    n = found.hash.size - size + 1
    if n <= 0:
        return np.empty(0, U64), *(np.empty(0, np.int64),) * 3, np.empty(0, bool)
    short = gram(found.hash, MINIMISER)
    least = sliding_min(short, size - MINIMISER + 1)
    row = found.row[:n]
    whole = row == found.row[size - 1 :]
    new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1]))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    keep = whole[first]
    first, length = first[keep], length[keep]
    if not first.size:
        return np.empty(0, U64), *(np.empty(0, np.int64),) * 3, np.empty(0, bool)
    spread = length + size - MINIMISER  # runs of MINIMISER words in each super-k-mer
    before = np.cumsum(spread) - spread
    at = np.arange(int(spread.sum())) + np.repeat(first - before, spread)
    times = np.add.reduceat((short[at] == np.repeat(least[first], spread)).astype(np.int64), before)
    return least[first], row[first], first, length, times == 1


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, source (a hash that tells apart the texts of one id), text."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("source"), "text")


def _minimisers(documents: DataFrame, size: int) -> DataFrame:
    """minimiser, doc_id, source for each super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, _, data, offsets in slices(batch.column(2)):
                least, row, _, _, alone = runs(Words(data, offsets), size)
                # one that holds its minimiser again may repeat a window by itself: it counts twice
                least, row = (np.repeat(x, 2 - alone) for x in (least, row))
                yield pa.RecordBatch.from_arrays([long(least), pa.array(ids[a + row]), pa.array(source[a + row])], names=["minimiser", "doc_id", "source"])

    return _texts(documents).where("doc_id is not null").mapInArrow(run, "minimiser long, doc_id long, source long")


def _packed(texts: DataFrame, size: int) -> DataFrame:
    """minimiser, digest, packed, alone (it holds its minimiser once), doc_id, source, start, n: the super-k-mers of the row's `minimisers`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, _, data, offsets in slices(batch.column(2)):
                found = Words(data, offsets)
                least, row, first, n, alone = runs(found, size)
                wanted = [np.sort(np.array(batch.column(3)[a + i].as_py(), np.int64).view(U64)) for i in range(offsets.size - 1)]
                ends = np.searchsorted(row, np.arange(offsets.size))
                keep = np.zeros(row.size, bool)
                for i, x in enumerate(wanted):
                    own = least[ends[i] : ends[i + 1]]
                    keep[ends[i] : ends[i + 1]] = x[np.minimum(np.searchsorted(x, own), x.size - 1)] == own
                least, row, first, n, alone = least[keep], row[keep], first[keep], n[keep], alone[keep]
                text = data.tobytes()
                starts, stops = found.start[first], found.end[first + n + size - 2]
                packed = [b" ".join(text[x:y].split()) for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
                digests = [xxhash.xxh3_128_digest(x) for x in packed]
                yield pa.RecordBatch.from_arrays([long(least), pa.array(digests, pa.binary()), pa.array(packed, pa.binary()), pa.array(alone, pa.bool_()), pa.array(ids[a + row]), pa.array(source[a + row]), pa.array((first - found.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["minimiser", "digest", "packed", "alone", "doc_id", "source", "start", "n"])

    return texts.mapInArrow(run, "minimiser long, digest binary, packed binary, alone boolean, doc_id long, source long, start int, n int")


def _windows(entries: DataFrame, size: int) -> DataFrame:
    """key1, key2, doc_id, source, start for each window of each packed string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for a, _, data, offsets in slices(batch.column(0).cast(pa.large_binary()).view(pa.large_string())):
                found = Words(data, offsets)
                last = found.hash.size - size + 1
                whole = np.flatnonzero(found.row[:last] == found.row[size - 1 :])
                row = found.row[whole]
                keys = [long(gram(found.hash, size, salt)[whole]) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids[a + row]), pa.array(source[a + row]), pa.array((start[a + row] + whole - found.first[row]).astype(np.int32))], names=["key1", "key2", "doc_id", "source", "start"])

    return entries.select("packed", "doc_id", "source", "start").mapInArrow(run, "key1 long, key2 long, doc_id long, source long, start int")


def repeated_windows(documents: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, source, start, n, stored: runs of windows whose words start earlier elsewhere."""
    place = ["doc_id", "source", "start"]
    found = _minimisers(documents, size)
    again = found.groupBy("minimiser").agg(F.count("*").alias("times")).where("times > 1").select("minimiser")
    flagged = found.join(again, "minimiser").groupBy("doc_id", "source").agg(F.collect_set("minimiser").alias("minimisers"))
    packed = _texts(documents).join(flagged, ["doc_id", "source"]).select("doc_id", "source", "text", "minimisers")
    packed = materialise(_packed(packed, size), "packed")
    places = packed.drop("packed")
    entries = materialise(places.groupBy("minimiser", "digest").agg(F.min(F.struct(*place)).alias("first"), F.min("alone").alias("alone")), "entries")
    copies = places.join(entries.drop("alone"), ["minimiser", "digest"]).where(F.struct(*place) > F.col("first")).select(*place, "n")
    copies = materialise(copies, "copies")
    buckets = entries.groupBy("minimiser").agg(F.count("*").alias("strings"), F.min("alone").alias("alone")).where("strings > 1 or not alone").select("minimiser")
    sorted_ones = entries.join(buckets, "minimiser").select("minimiser", "digest", "first.*")
    strings = packed.select("minimiser", "digest", *place, "packed").join(sorted_ones, ["minimiser", "digest", *place])
    windows = materialise(_windows(strings, size), "windows")
    discard(packed, entries)
    first = windows.groupBy("key1", "key2").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = windows.join(first, ["key1", "key2"]).where(F.struct(*place) > F.col("first")).select(*place, F.lit(1).alias("n"))
    out = materialise(copies.union(later), "repeats")
    discard(copies, windows)
    return out


def remove_repeats(documents: DataFrame, size: int = 20, digest: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 of the kept words joined by spaces, or with digest=False these as `kept`."""
    bound_batches(documents.sparkSession)
    gone = repeated_windows(documents, size).groupBy("doc_id", "source").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    kind = pa.string() if digest else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()
                total.append(len(words))
                if spans.is_valid:
                    out = np.zeros(len(words) + 1, np.int64)
                    start, n = (x.to_numpy() for x in spans.values.flatten())
                    np.add.at(out, start, 1)
                    np.add.at(out, start + n + size - 1, -1)
                    keep = np.cumsum(out[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(total[-1] - len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, kind)], names=["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept"
    return _texts(documents).join(gone, ["doc_id", "source"], "left").select("doc_id", "text", "gone").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} {'string' if digest else 'binary'}")
