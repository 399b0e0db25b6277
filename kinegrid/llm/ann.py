"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: their centred coordinates in a learned rotation (iterative quantisation, fitted on a bounded
sample), one bit each. A code is split into substrings of 8 bits (or of 16: parameter `substring`), each an index of its
own. Of two codes within a Hamming radius some substring differs by no more than the radius over the number of substrings:
probing each substring's values within that finds every such code. Each query first looks into its own buckets; the radius
is that at which a vector as near as the k-th best found there would lie with high probability. All codes within it whose vectors
are no worse are reranked by the exact inner product of the original vectors.

An index holds every row once for each substring, dealt by the first bits of the substring's value; queries go to the
shards that their balls reach, and rows and queries meet by equality. A pair counts in the first substring that finds it, so
that no hit is repeated, and only rows at least as near as the k-th best so far leave a task. Equal vectors are one entry of the
index with its k + 1 least ids, which is all that a result can show of them.

Rows: vectors that are null, zero, of another dimension than most (the larger one, if two are as frequent), or that hold null or
non-finite components take no part, as queries either; rows that repeat an id and vector count once; an id with several
vectors asks by the least of them and is found by its nearest; rows without an id take no part; ties go to the smaller id; with fewer
candidates than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bound_batches, discard, materialise

SHARD_ROWS, SHARD_QUERIES = 8192, 4096
#: Vectors that the rotation is fitted on at most.
SAMPLE = 8192
#: Standard deviations above its expected distance at which a vector as near as the k-th best is still found.
MARGIN = 1.0
#: Bits compared at once.
CELLS = 1 << 22


@dataclass
class Codes:
    """mean and projection of the learned codes; `longest` turns inner products into angles."""

    mean: np.ndarray
    projection: np.ndarray
    longest: float

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, bytes). Vectors get a coordinate that makes all of one length, so that the largest inner
        product is the smallest angle."""
        return self._bits(np.column_stack([vectors, np.sqrt(np.clip(self.longest**2 - (vectors**2).sum(axis=1), 0, None))]))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        scale = self.longest / np.linalg.norm(vectors, axis=1, keepdims=True)
        return self._bits(np.column_stack([vectors * scale, np.zeros(len(vectors))]))

    def _bits(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits((lifted - self.mean) @ self.projection > 0, axis=1)


def substrings(codes: np.ndarray, substring: int) -> np.ndarray:
    """(rows, substrings) values of 8 or 16 bits."""
    return codes.astype(np.int32) if substring == 8 else codes[:, ::2].astype(np.int32) << 8 | codes[:, 1::2]


def learn(sample: np.ndarray, longest: float, substring: int = 8, rounds: int = 30) -> Codes:
    """Iterative quantisation (Gong and Lazebnik 2011): the rotation that brings the sample nearest to its own signs."""
    dimension = sample.shape[1]
    bits = -(-dimension // substring) * substring
    lift = np.sqrt(np.clip(longest**2 - (sample**2).sum(axis=1), 0, None))
    full = np.column_stack([sample, lift])
    mean = full.mean(axis=0)
    centred = full - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    projection = axes[: min(bits, axes.shape[0])].T
    if projection.shape[1] < bits:  # more bits than axes: further random directions
        projection = np.column_stack([projection, np.random.default_rng(7).normal(size=(dimension + 1, bits - projection.shape[1]))])
    low = centred @ projection
    rotation, _ = np.linalg.qr(np.random.default_rng(11).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(low @ rotation).T @ low)
        rotation = (u @ v).T
    return Codes(mean, projection @ rotation, longest)


def reaches(radius: Column, m: int) -> Column:
    """How far each of `m` substrings is probed, so that every code within the radius is found: by the pigeonhole principle only
    radius % m + 1 of the indexes need the full share, the others one less (-1: not at all)."""
    full, rest = F.floor(radius / m).cast("int"), radius % m
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.when(j <= rest, full).otherwise(full - 1))


@dataclass
class Shard:
    """A part of one substring's index: vectors by the value of substring `j`."""

    j: int
    ids: np.ndarray
    vectors: np.ndarray
    parts: np.ndarray  # (rows, substrings)

    def __post_init__(self):
        order = np.argsort(self.parts[:, self.j], kind="stable")
        self.ids, self.vectors, self.parts = self.ids[order], self.vectors[order], self.parts[order]
        self.values, first = np.unique(self.parts[:, self.j], return_index=True)
        self.first = np.append(first, order.size)

    def bucket_rows(self, own: int, reach: int) -> np.ndarray:
        """Rows of the buckets whose value differs from `own` in `reach` bits at most."""
        hit = np.flatnonzero(np.bitwise_count(self.values ^ own) <= reach)
        return np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in hit]) if hit.size else np.empty(0, np.int64)

    def within(self, parts: np.ndarray, rows: np.ndarray, reach: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, rows): whether a row's code is within the query's radius, and in no bucket probed of an earlier substring."""
        apart = np.bitwise_count(parts[:, None] ^ self.parts[None, rows])
        earlier = (apart[:, :, : self.j] <= reach[:, None, : self.j]).any(axis=2)
        return (apart.sum(axis=2, dtype=np.int64) <= radius[:, None]) & ~earlier


def best_of_shard(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, parts: np.ndarray, reach: np.ndarray, radius: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best rows that the probed buckets give within each query's radius and with its floor at least."""
    own = parts[:, shard.j]
    for value, far in np.unique(np.column_stack([own, reach[:, shard.j]]), axis=0):
        rows = shard.bucket_rows(int(value), int(far))
        same = np.flatnonzero((own == value) & (reach[:, shard.j] == far))
        step = max(1, CELLS // max(1, rows.size * parts.shape[1]))
        for q in (same[i : i + step] for i in range(0, same.size if rows.size else 0, step)):
            vectors = shard.vectors[rows]
            rough = queries[q] @ vectors.T
            slack = 1e-9 * np.abs(rough).max()
            keep = shard.within(parts[q], rows, reach[q], radius[q]) & (rough >= floor[q, None] - slack) & (shard.ids[rows][None] != query_ids[q, None])
            for i, one in enumerate(q):
                at = np.flatnonzero(keep[i])
                if at.size > k:
                    at = at[rough[i, at] >= np.partition(rough[i, at], at.size - k)[at.size - k] - slack]
                if at.size:
                    scores = (vectors[at] * queries[one]).sum(axis=1)  # row by row, so that equal vectors have equal scores
                    order = np.lexsort((shard.ids[rows[at]], -scores))[:k]
                    yield int(one), shard.ids[rows[at[order]]], scores[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats or doubles) of the rows that take part."""
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return rows.where(F.size("embedding") == F.lit(common["d"] if common else 0)).distinct()


def coded(rows: DataFrame, codes, substring: int, as_queries: bool) -> DataFrame:
    """Adds `parts`, the values of the code's substrings, and for queries their norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            parts = substrings(codes.value.of_queries(data) if as_queries else codes.value.of(data), substring)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1) * parts.shape[1], pa.int32()), pa.array(parts.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(np.linalg.norm(data, axis=1))], names=["vec_id", "embedding", "parts", "norm"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, parts array<int>, norm double")


def probe(index: DataFrame, asked: DataFrame, substring: int, prefix: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best that each shard finds for each row of `asked` (query_id, embedding, parts, reach,
    radius, floor).

    A substring's index is dealt over shards by the first `prefix` bits of its values, and a query goes to the shards that its
    ball reaches: rows and queries meet by equality of (substring, shard). Large shards and many queries are cut to blocks."""
    shard = F.shiftright("value", substring - prefix)
    held = index.select("vec_id", "embedding", "parts", F.posexplode("parts").alias("j", "value")).withColumn("shard", shard)
    reach = lambda c: F.filter(F.sequence(F.lit(0), F.lit((1 << prefix) - 1)), lambda p: F.bit_count(p.bitwiseXOR(c)) <= F.col("far"))
    queries = asked.select("query_id", "embedding", "parts", "reach", "radius", "floor", F.posexplode("parts").alias("j", "value")).withColumn("far", F.element_at("reach", F.col("j") + 1))
    queries = queries.where("far >= 0").withColumn("shard", F.explode(reach(shard))).drop("far", "value")
    # the sizes of each shard, without the vectors
    blocks = lambda df, name, most: df.groupBy("j", "shard").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = blocks(held, "rows", SHARD_ROWS).join(blocks(queries, "chunks", SHARD_QUERIES), ["j", "shard"])
    dealt = lambda df, key, own, mine, other, count: df.join(sizes, ["j", "shard"]).withColumns({own: F.pmod(F.xxhash64(key, "j"), F.col(mine)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(count) - 1))})
    left = dealt(held, "vec_id", "block", "rows", "chunk", "chunks").select("j", "shard", "block", "chunk", "vec_id", "embedding", "parts")
    right = dealt(queries, "query_id", "chunk", "chunks", "block", "rows").select(*(F.col(x).alias(f"q_{x}") for x in ("j", "shard", "block", "chunk")), "query_id", *(F.col(x).alias(f"q_{x}") for x in ("embedding", "parts", "reach")), "radius", "floor")

    def join(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(asked):
            stacked = lambda column, kind: np.stack(column.to_numpy()).astype(kind)
            shard = Shard(int(rows["j"].iloc[0]), rows["vec_id"].to_numpy(np.int64), stacked(rows["embedding"], np.float64), stacked(rows["parts"], np.int32))
            query_ids = asked["query_id"].to_numpy(np.int64)
            found = best_of_shard(shard, query_ids, stacked(asked["q_embedding"], np.float64), stacked(asked["q_parts"], np.int32), stacked(asked["q_reach"], np.int32), asked["radius"].to_numpy(np.int64), asked["floor"].to_numpy(np.float64), k)
            out = [(np.full(ids.size, query_ids[i]), ids, scores) for i, ids, scores in found]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = ["j", "shard", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"q_{x}" for x in keys))).applyInPandas(join, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank; an id counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, margin: float = MARGIN, substring: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest by inner product for each query (ids divisible by `every`).
    `substring` is the length of the indexed parts of a code: 16 bits make fewer, finer buckets, at any number of vectors."""
    if substring not in (8, 16):
        raise ValueError("substrings have 8 or 16 bits")
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = materialise(usable(vectors), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    n, longest = rows.agg(F.count("*"), F.max(norm)).first()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("embedding").collect()
    model = learn(np.array([r[0] for r in sample], np.float64), longest, substring) if sample else None
    codes = spark.sparkContext.broadcast(model)
    bits = model.projection.shape[1] if model else substring
    m, prefix = bits // substring, min(substring, max(0, round(np.log2(max(n, 1) / SHARD_ROWS)) + 1))
    # of equal vectors the k + 1 least ids: first in each of many parts, then over the parts
    equal = lambda *more: Window.partitionBy("embedding", *more).orderBy("vec_id")
    index = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256))).withColumn("at", F.row_number().over(equal("part"))).where(F.col("at") <= k + 1)
    index = index.withColumn("at", F.row_number().over(equal())).where(F.col("at") <= k + 1).select("vec_id", "embedding")
    index = materialise(coded(index, codes, substring, False).drop("norm"), "index")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialise(coded(asked, codes, substring, True).withColumnRenamed("vec_id", "query_id"), "asked")
    discard(rows)
    # first each query's own buckets, whatever the radius: their k-th best gives the radius
    first = asked.withColumns({"reach": F.lit([0] * m), "radius": F.lit(bits), "floor": F.lit(float("-inf"))})
    first = materialise(ranked(probe(index, first, substring, prefix, k), k), "first")
    known = first.groupBy("query_id").agg(F.when(F.max("rank") == k, F.min("score")).alias("kth"))
    at = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("kth") / (F.col("norm") * F.lit(longest))))
    share = F.acos(at) / F.lit(np.pi)
    radius = F.when(F.col("kth").isNull(), bits).otherwise(F.least(F.lit(bits), F.ceil(bits * share + margin * F.sqrt(bits * share * (1 - share))))).cast("int")
    asked = asked.join(known, "query_id", "left").withColumn("radius", radius).withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
    asked = asked.withColumn("reach", reaches(F.col("radius"), m))
    second = probe(index, asked, substring, prefix, k)
    return ranked(second.union(first.select("query_id", "vec_id", "score")), k).select("query_id", "rank", "vec_id", "score")
