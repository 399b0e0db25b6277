"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised, closed with id 0 and cut into pieces of at most `capacity` tokens (only longer ones; the first
piece may be shorter). Lengths are at most `capacity`, so their histogram has a fixed size: the plan is made on it, on
the driver, and says for each length which of its pieces (by rank) goes to which sequence and place. Ranks within a length
are dealt over hashed buckets, so that a length that a third of all pieces have is no single group.

With `added` the vocabulary's added tokens are found in texts first and have their ids there, as the `tokenizers` library has it
by default; without, their strings are ordinary text.

Rows: a null text is an empty one (a piece with id 0 alone); equal rows give equal pieces, each placed once, and so do rows
that repeat an id and those without an id, whose pieces have none; texts of any length are cut whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder, byte_chars
from .common import bound_batches, materialise

#: Buckets that ranks within a length are dealt over at least, and pieces for each bucket beyond that.
RANK_BUCKETS, BUCKET_PIECES = 256, 1 << 20


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file of the `tokenizers` library; ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    back = {c: b for b, c in enumerate(byte_chars())}
    special = {x["content"] for x in data.get("added_tokens", [])}
    return {bytes(back[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


def read_added(path: str) -> dict[str, int]:
    """Added tokens -> id. Of those that start at one place the longest counts."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", [])
    if any(x.get(k) for x in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take white space, whole words or normalised text are not supported")
    return {x["content"]: x["id"] for x in sorted(tokens, key=lambda x: -len(x["content"]))}


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    start, end = 0, n - (n - 1) // capacity * capacity
    while start < n:
        yield start, end - start
        start, end = end, end + capacity


#: By vocabulary and pattern; kept between the tasks of a worker process.
_encoders: dict[tuple, TextEncoder] = {}


def pieces(documents: DataFrame, vocabulary_path: str, pattern: str, capacity: int = 2048, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    spark = documents.sparkSession
    bound_batches(spark)
    vocabulary = read_vocabulary(vocabulary_path)
    tokens = {x: struct.pack("<I", i) for x, i in read_added(vocabulary_path).items()} if added else {}
    parts = re.compile("(" + "|".join(map(re.escape, tokens)) + ")") if tokens else None
    ranks, key = spark.sparkContext.broadcast(vocabulary), (zlib.crc32(repr(sorted(vocabulary.items())).encode()), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
            _encoders[key] = TextEncoder(lambda x: struct.pack(f"<{len(i := own.encode_ordinary(x))}I", *i), pattern)
        encoder = _encoders[key]
        whole = lambda text: b"".join(tokens[x] if x in tokens else encoder(x) for x in parts.split(text) if x) if parts and parts.search(text) else encoder(text)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(whole(text or "") + b"\0\0\0\0")
                rows += [(doc, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = [*zip(*rows, strict=True)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Which one, two or three lengths fill a gap exactly, under counts of what is there.

    For each sum the index holds a place in the order of its combinations, the longest length first. Counts only fall, so a combination
    that is used up never comes back: each sum moves on from there, and all look-ups together pass each combination once."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.there = [0] * (capacity + 1)
        for length, n in histogram.items():
            self.there[length] = n
        self.pair_at = [max(0, total - 1) for total in range(capacity + 1)]
        self.triple_at = [max(0, total - 2) for total in range(capacity + 1)]

    def take(self, lengths: Iterable[int], times: int = 1) -> None:
        for x in lengths:
            self.there[x] -= times

    def enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.there[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int) -> tuple[int, int] | None:
        there, a = self.there, self.pair_at[total]
        while 2 * a >= total and a and not (there[a] and there[total - a] and (2 * a != total or there[a] > 1)):
            a -= 1
        self.pair_at[total] = a
        return (a, total - a) if a and 2 * a >= total else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        a = self.triple_at[total]
        while a and 3 * a >= total:
            if self.there[a] and self.pair(total - a):
                b, least = min(a, self.pair_at[total - a]), -(-(total - a) // 2)
                while b >= least:
                    if self.enough((a, b, total - a - b)):
                        self.triple_at[total] = a
                        return a, b, total - a - b
                    b -= 1
            a -= 1
        self.triple_at[total] = a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """The fewest lengths that sum to `gap`, then the longest first."""
        return (gap,) if self.there[gap] else self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, number of such sequences): the longest piece left opens a sequence; what is left of
    it is filled exactly by up to three lengths if they are there, else by the longest that fits, and so on."""
    index, out, longest = SumIndex(histogram, capacity), [], capacity
    while True:
        while longest and not index.there[longest]:
            longest -= 1
        if not longest:
            return out
        lengths, gap = [longest], capacity - longest
        index.take(lengths)
        while gap:
            more = index.exact(gap) or next(((x,) for x in range(min(gap, longest), 0, -1) if index.there[x]), None)
            if not more:
                break
            index.take(more)
            lengths += more
            gap -= sum(more)
        # the same again as often as all of its lengths are there
        uses = Counter(lengths)
        again = min(index.there[x] // n for x, n in uses.items())
        index.take(lengths, again)
        out.append((tuple(lengths), 1 + again))


def place(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows of `pieces`, which must be stored (they are read four times)."""
    spark = found.sparkSession
    buckets = max(RANK_BUCKETS, -(-found.count() // BUCKET_PIECES))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    found = found.withColumn("bucket", bucket)
    sizes = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, base, taken = [], 0, Counter()
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for x in lengths:
            rows.append((x, taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    slots = np.array(sorted(rows), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(slots)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        order = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = slots[np.searchsorted(order, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(documents: DataFrame, vocabulary_path: str, pattern: str, capacity: int = 2048, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return place(materialise(pieces(documents, vocabulary_path, pattern, capacity, added), "pieces"), capacity)
