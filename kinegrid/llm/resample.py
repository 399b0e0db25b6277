"""Target-distribution importance resampling: documents are drawn by how much likelier their n-grams are in the target.

Features are the runs of 1 to `orders` consecutive words, counted by the CRC-32 of their bytes modulo `buckets`. A bucket's gain
is the smoothed logarithm of the ratio of its shares in target and source, a document's weight the mean gain of its features, and
noise of its own (Gumbel, of a hash of its id) makes the highest scores a sample without replacement.

- Equal texts are grouped by the full text, which Spark pre-aggregates before it shuffles; each text's features are computed
  once and stored as 2-byte buckets, its counts multiplied by the number of copies. A text's partial counts leave Python as one
  histogram for each task.
- Weights are joined back to the documents by SHA-256 of the text, before the noise of each document is added.
- Ranks come from ranges of (score, doc_id), each sorted by itself and shifted by the sizes of those before it: no task
  sees all documents, and what reaches the driver is a row for each range and bucket.

CRCs of words are computed for all words of a slice at once, those of longer runs from the CRCs of their words: the CRC of a
concatenation is the first one's, shifted by the length of the second, plus the second one's.

Rows: a null or empty text has no features and weight 0; texts are read whole; rows that repeat an id are documents of their own with
equal noise; rows without an id count in the source, but have no score and are not drawn; an empty table gives an empty result,
an empty target a uniform one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, long, materialise, slices

#: Bytes of a word up to which CRCs are computed for all words at once.
SHORT = 48
#: Drawn documents of a range that one task ranks.
RANGE_ROWS = 1 << 18
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


_TABLE = _byte_table()


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as four tables by byte, of each value."""
    out = tables[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_tables(steps: int = 31) -> list[np.ndarray]:
    """For each power of two the map that a CRC goes through when so many zero bytes follow."""
    own = np.arange(256, dtype=np.uint32)
    values = np.stack([own << np.uint32(8 * k) for k in range(4)])
    out = [np.stack([_TABLE[v & np.uint32(255)] ^ (v >> np.uint32(8)) for v in values])]
    while len(out) < steps:
        out.append(np.stack([_applied(out[-1], x) for x in out[-1]]))
    return out


_SHIFTS = _shift_tables()


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, of the CRCs of their parts and the length of the second."""
    out, left, k = first.copy(), np.asarray(length, np.int64), 0
    while (left >> k).any():
        odd = np.flatnonzero((left >> k) & 1)
        out[odd] = _applied(_SHIFTS[k], out[odd])
        k += 1
    return out ^ second


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words `[0-9a-z\\x80-\\xFF]+` of a slice of lower-cased texts."""
    solid = _WORD[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(offsets, start, "right") - 1


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    length = end - start
    state = np.full(start.size, 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(length <= SHORT)
    for k in range(SHORT):
        some = some[length[some] > k]
        if not some.size:
            break
        x = state[some]
        state[some] = _TABLE[(x ^ data[start[some] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        state[i] = zlib.crc32(data[start[i] : end[i]])
    return state


def features(column: pa.Array, orders: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, bucket) of the features of each slice of a text column, rows ascending."""
    blank = np.uint32(zlib.crc32(b" "))
    for a, b, data, offsets in slices(column):
        data = _LOWER[data]
        start, end, row = word_ranges(data, offsets)
        words = word_crcs(data, start, end)
        length = end - start
        spaced = crc_joined(np.full(words.size, blank), words, length)
        rows, found, last = [row], [words], words
        for n in range(1, orders):
            last = crc_joined(last[:-1], spaced[n:], length[n:] + 1) if last.size else last
            same = row[: last.size] == row[n:] if last.size else np.empty(0, bool)
            rows.append(row[: last.size][same])
            found.append(last[same])
        row, found = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")
        yield a, b, row[order], found[order].astype(np.int64) % buckets


def hashed(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """For each row of (key, copies, text): key, n (number of features), features (buckets as 2-byte numbers, 4-byte beyond 65,536); and for each task
    and bucket a row of bucket and count, times the copies."""
    width = np.uint16 if buckets <= 1 << 16 else np.uint32
    names = ["key", "n", "features", "bucket", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for a, b, row, found in features(batch.column(2), orders, buckets):
                # bincount sums in doubles: exact below 2^53
                total += np.bincount(found, weights=copies[a + row], minlength=buckets).astype(np.int64)
                n = np.bincount(row, minlength=b - a)
                parts = np.split(found.astype(width), np.cumsum(n)[:-1])
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), long(n), pa.array([x.tobytes() for x in parts], pa.binary()), none, none], names=names)
        some = np.flatnonzero(total)
        none = pa.nulls(some.size)
        yield pa.RecordBatch.from_arrays([none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.binary()), long(some), long(total[some])], names=names)

    return texts.select("key", "copies", "text").mapInArrow(run, "key binary, n long, features binary, bucket long, count long")


def grouped(texts: DataFrame) -> DataFrame:
    """key (SHA-256), copies, text of each different text."""
    same = texts.groupBy("text").agg(F.count("*").alias("copies"))
    return same.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")


def counts(found: DataFrame) -> DataFrame:
    return found.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, of the counts of both sides: `buckets` rows at most reach the driver."""
    spark = source.sparkSession
    s, t = source.withColumnRenamed("count", "s"), target.withColumnRenamed("count", "t")
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source"), F.coalesce(F.sum("t"), F.lit(0)).alias("target"))
    every = spark.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left").select("bucket", *(F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("s", "t")))
    a, b = total.first()
    ratio = ((F.col("t") + 1) * F.lit(float(a + buckets))) / ((F.col("s") + 1) * F.lit(float(b + buckets)))
    out = np.zeros(buckets, np.int64)
    for bucket, gain in every.select("bucket", F.floor(1000 * F.log(ratio))).collect():
        out[bucket] = gain
    return out


def weights(found: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """key, n, weight of each different text."""
    shared = found.sparkSession.sparkContext.broadcast(gain)
    width = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            n = batch.column(1).to_numpy()
            sums = np.array([int(of[np.frombuffer(x.as_buffer(), width)].sum()) for x in batch.column(2)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(np.floor_divide(sums, np.maximum(n, 1)))], names=["key", "n", "weight"])

    return found.where("bucket is null").select("key", "n", "features").mapInArrow(run, "key binary, n long, weight long")


def ranks(scored: DataFrame, n: int) -> DataFrame:
    """`scored` (with a column score) with the rank by score, highest first, then doc_id, of the first `n` rows."""
    ranges = max(1, -(-n // RANGE_ROWS))
    # scores below the last one wanted need no order: a histogram by score finds it (scores are whole numbers, a row for each)
    by_score = scored.where("score is not null").groupBy("score").agg(F.count("*").alias("rows"))
    cut = by_score.withColumn("part", F.floor(F.col("score") / 1000))
    parts = cut.groupBy("part").agg(F.sum("rows").alias("rows")).orderBy(F.desc("part")).collect()  # one for each nat of weight
    left, least = n, None
    for part, rows in parts:
        least, left = part, left - rows
        if left <= 0:
            break
    if n == 0 or least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    inside = F.col("score").isNotNull() & (F.floor(F.col("score") / 1000) >= least)
    drawn = scored.where(inside).withColumn("order", -F.col("score")).repartitionByRange(ranges, "order", "doc_id").sortWithinPartitions("order", "doc_id").withColumn("place", F.monotonically_increasing_id()).drop("order")
    drawn = materialise(drawn, "drawn")
    part, mask = F.shiftright("place", 33), (1 << 33) - 1
    sizes = drawn.groupBy(part.alias("range")).agg(F.count("*").alias("rows"))
    before = sizes.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))  # a row for each range
    placed = drawn.withColumn("range", part).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit(mask)) + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).select(*scored.columns, "rank")
    return placed.union(scored.where(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, orders: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank: `percent` of the documents with at least `least_words` words are drawn."""
    spark = documents.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = materialise(hashed(grouped(docs), orders, buckets), "features")
    aim = materialise(counts(hashed(grouped(target.select(text.alias("text"))), orders, buckets)), "target")
    gain = gains(counts(found), aim, buckets)
    weighed = materialise(weights(found, gain, buckets), "weights")
    discard(found, aim)
    keyed = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = keyed.join(weighed, "key").select("doc_id", F.col("n").alias("n_features"), "weight", (F.col("weight") + noise).alias("score"))
    scored = materialise(scored, "scored")
    discard(weighed)
    # a text of w words has w + (w - 1) + ... features
    least = sum(max(0, least_words - k) for k in range(orders))
    fit = F.col("doc_id").isNotNull() & (F.col("n_features") >= least)
    drawn = percent * scored.where(fit).count() // 100
    marked = scored.withColumn("own", F.col("score")).withColumn("score", F.when(fit, F.col("score")))
    return ranks(marked, drawn).select("doc_id", "n_features", "weight", F.col("own").alias("score"), "rank")
