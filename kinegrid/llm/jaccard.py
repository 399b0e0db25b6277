"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class. Every set has an
order (shingles that are known to be frequent last, else by hash), and the shingles of its prefix go to index lists with
their positions: two sets that link share a shingle of both prefixes. Which shingles count as frequent is a bounded hint
that changes the order alone, never the result.

- Answers of one set first: each list has a pivot, the class whose prefix is the most common, and every other class of the
  list is compared with it alone. A class within RADIUS times the largest difference of a link joins the pivot's star, and is
  known from then on by the few shingles in which it differs from that star's centre: copies around the threshold, which link
  with some of each other only, share a star, too.
- Index-level skipping: the lists keep one entry for each star and block of sizes. An entry is in a list's head block if its
  position leaves room for an overlap with a set of its own size, else in the tail: of a pair found by its first common
  shingle the smaller set is in the head, so that tails never meet tails. Parities of 256 bits bound the difference of two
  centres from below and drop most pairs of stars before their sets are read.
- Answer-level skipping: what a class links with in its own or another star is derived from the centres' answer, corrected by
  the differing shingles: the difference of two members is the symmetric difference of three short lists. Stars are compared in
  blocks of bounded size, in which links are counted, not emitted: what leaves a task is a forest that spans its links.

Rows: a null or empty text, or one of white space, has no shingle and is linked with nothing; a text with fewer words
than a shingle has its whole sequence as one; texts are read whole; repeated rows are linked with each other, and rows that
repeat an id with other texts are judged each by its own text; rows without an id take no part; an empty table gives an empty
result; other columns are ignored, and stay in `representatives` under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import U64, Words, bound_batches, discard, gram, long, materialise, mix, slices, unused

#: At most so many frequent shingles (8 bytes each) are broadcast.
FREQUENT = 100_000
#: 64-bit words of parities of a set.
PARITIES = 4
#: Radius of a star, in largest differences of two sets that link.
RADIUS = 2
#: Differing shingles (and 32 for each class) of a block of a star, and cells of a table of overlaps.
BLOCK, CELLS = 1 << 20, 1 << 22
_BITS = [f"bits{i}" for i in range(PARITIES)]


def shingle_sets(column: pa.Array, words: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text of an Arrow column."""
    for row, end, data, offsets in slices(column):
        found = Words(data, offsets, lower)
        grams = gram(found.hash, words)
        for i in range(end - row):
            a, b = int(found.first[i]), int(found.first[i + 1])
            if b - a >= words:
                out = np.sort(grams[a : b - words + 1])
                yield row + i, out[np.append(True, out[1:] != out[:-1])]
            else:
                yield row + i, gram(found.hash[a:b], b - a, salt=b - a) if b > a else np.empty(0, U64)


def least_overlap(n, percent: int):
    """The least intersection of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def most_apart(a: str, b: str, percent: int) -> Column:
    """The largest symmetric difference of two sets of these sizes that link."""
    return F.floor((F.col(a) + F.col(b)).cast("long") * (100 - percent) / (100 + percent) + 1e-9).cast("long")


def _texts(documents: DataFrame) -> DataFrame:
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", "text", F.xxhash64("text").alias("source"))


def frequent_shingles(documents: DataFrame, words: int, lower: bool) -> np.ndarray:
    """The shingles that most documents hold, sorted: of those that some batch has three times, as many levels of
    counts, from the highest, as give FREQUENT shingles at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, x in shingle_sets(batch.column(0), words, lower)]
            found, times = np.unique(np.concatenate(sets) if sets else np.empty(0, U64), return_counts=True)
            keep = times >= 3
            yield pa.RecordBatch.from_arrays([long(found[keep]), long(times[keep])], names=["shingle", "times"])

    counts = _texts(documents).select("text").mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    counts = materialise(counts.withColumn("level", F.floor(8 * F.log2("times")).cast("int")), "frequent")
    levels, room, least = counts.groupBy("level").count().collect(), FREQUENT, 1 << 30  # a row for each power of 2^(1/8)
    for level, n in sorted(levels, reverse=True):
        room -= n
        if room < 0:
            break
        least = level
    top = counts.where(F.col("level") >= least).select("shingle").collect()
    discard(counts)
    return np.sort(np.array([r[0] for r in top], np.int64).view(U64))


def prefixes(documents: DataFrame, frequent: np.ndarray, words: int, percent: int, lower: bool) -> DataFrame:
    """doc_id, source, n, sum1, sum2 (a digest of the set), the parities, and prefix (the shingles of the prefix in order)."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    names = ["doc_id", "source", "n", "sum1", "sum2", *_BITS, "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            size, sums, bits, prefix = [], [[], []], [], []
            for _, x in shingle_sets(batch.column(1), words, lower):
                size.append(x.size)
                for k in (0, 1):
                    sums[k].append(mix(x, k + 7).sum(dtype=U64))
                odd = np.bincount((x & U64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                known = often[np.minimum(np.searchsorted(often, x), often.size - 1)] == x if often.size else np.zeros(x.size, bool)
                length = x.size - least_overlap(x.size, percent) + 1 if x.size else 0
                prefix.append(np.concatenate([x[~known], x[known]])[:length].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            parities = np.array(bits, np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int32()), *(long(np.array(s, U64)) for s in sums), *(pa.array(np.ascontiguousarray(x)) for x in parities.T), lists], names=names)

    kinds = ", ".join(f"{b} long" for b in _BITS)
    return _texts(documents).mapInArrow(run, f"doc_id long, source long, n int, sum1 long, sum2 long, {kinds}, prefix array<long>")


def _apart(left: str, right: str) -> Column:
    """A lower bound of the symmetric difference, by parities."""
    return sum((F.bit_count(F.col(f"{left}{b}").bitwiseXOR(F.col(f"{right}{b}"))) for b in _BITS), F.lit(0))


def differences(pairs: DataFrame, heads: DataFrame, documents: DataFrame, words: int, lower: bool, rate: int = 1) -> DataFrame:
    """a, b, differ for each pair (a, b, most) of classes: the shingles that one of both sets has, if they are `most` or fewer.

    Shingles that both prefixes hold are counted first. All others that a pair can share lie behind one of the prefixes, so
    that most pairs fall out without their sets. With a `rate` beyond 1 these counts must leave room for most / rate only: pairs
    of which the prefixes alone do not tell that they are near copies are left out."""
    side = lambda n: heads.select(F.col("c").alias(n), F.col("n").alias(f"n_{n}"), F.col("prefix").alias(f"p_{n}"))
    # the pairs grow with the documents: these joins are merged at every size, not broadcast at small ones
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    common = F.size(F.array_intersect("p_a", "p_b")) + F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    least = F.col("n_a") + F.col("n_b") - 2 * F.least(common, "n_a", "n_b")
    pairs = materialise(both.where(rate * least <= F.col("most")).select("a", "b", "most"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(heads.select("c", "doc_id", "source").hint("merge"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for _, x in shingle_sets(batch.column(1), words, lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["c", "shingles"])

    sets = _texts(documents).join(wanted.hint("merge"), ["doc_id", "source"]).select("c", "text").mapInArrow(run, "c long, shingles binary")
    sets = materialise(sets.dropDuplicates(["c"]), "sets")
    whole = lambda n: sets.select(F.col("c").alias(n), F.col("shingles").alias(f"set_{n}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (most, x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                twice = both[1:] == both[:-1]
                differ = both[~(np.append(False, twice) | np.append(twice, False))]
                if differ.size <= most:
                    keep.append(i)
                    out.append(differ.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)), lists], names=["a", "b", "differ"])

    joined = pairs.hint("merge").join(whole("a"), "a").hint("merge").join(whole("b"), "b").select("a", "b", "most", "set_a", "set_b")
    out = materialise(joined.mapInArrow(compare, "a long, b long, differ array<long>"), "differences")
    discard(pairs, sets)
    return out


def shared_lists(heads: DataFrame) -> DataFrame:
    """token, c, n, pos, entries: the entries of lists that more than one class is in."""
    entries = heads.select("c", "n", F.posexplode("prefix").alias("pos", "token"))
    # n is counted, not rows, so that both sides of the join below read one shuffle of the prefixes
    lists = entries.groupBy("token").agg(F.count("n").alias("entries")).where("entries > 1")
    return materialise(entries.join(lists, "token"), "lists")


def stars(shared: DataFrame, heads: DataFrame, documents: DataFrame, words: int, percent: int, lower: bool) -> DataFrame:
    """c, centre, differ for the classes within RADIUS of a centre: the nearest pivot that is in no star itself."""
    # a class of which all shingles are in long lists is amid its near copies
    score = shared.groupBy("c").agg((F.sum(F.log2("entries")) / F.max("n")).alias("score"))
    ranked = shared.join(score.join(heads.select("c", *_BITS), "c"), "c")
    pivots = ranked.groupBy("token").agg(F.max(F.struct("score", (-F.col("c")).alias("other"), "n", "pos", *_BITS)).alias("p"))
    pivots = pivots.select("token", (-F.col("p.other")).alias("b"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b"), *(F.col(f"p.{x}").alias(f"b_{x}") for x in _BITS))
    room = F.expr(f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
    most = RADIUS * most_apart("n", "n_b", percent)
    # a pair is found by its first common shingle, before which it shares none: only what is left of both can be common
    fits = 2 * F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) >= F.col("n") + F.col("n_b") - most
    pairs = ranked.join(pivots, "token").where((F.col("c") != F.col("b")) & room & fits & (_apart("", "b_") <= most))
    close = differences(pairs.select(F.col("c").alias("a"), "b", most.alias("most")).distinct(), heads, documents, words, lower, RADIUS)
    inner = close.join(close.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    best = inner.groupBy("a").agg(F.min(F.struct(F.size("differ").alias("d"), "b")).alias("best")).select("a", "best.b")
    out = materialise(inner.join(best, ["a", "b"]).select(F.col("a").alias("c"), F.col("b").alias("centre"), "differ"), "stars")
    discard(close)
    return out


def near_stars(shared: DataFrame, members: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """a, b, most: the pairs of centres that may have members which link."""
    width = np.log(100 / percent) * 1.001  # a little over the largest ratio of sizes: sets that link are in neighbouring blocks
    named = shared.join(members.select("c", "centre"), "c", "left").withColumn("centre", F.coalesce("centre", "c")).withColumn("block", F.floor(F.log("n") / width).cast("int"))
    head = F.expr(f"{100 + percent} * (n - pos) >= {2 * percent} * n")
    entries = named.groupBy("token", "block", "centre").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max(F.when(head, F.col("n") - F.col("pos"))).alias("head"))
    several = entries.groupBy("token").agg(F.min("centre").alias("x"), F.max("centre").alias("y")).where("x < y").select("token")
    reach = members.groupBy("centre").agg(F.max(F.size("differ")).alias("reach"))
    centres = heads.select(F.col("c").alias("centre"), *_BITS).join(reach, "centre", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    entries = materialise(entries.join(several, "token").join(centres, "centre"), "open")
    columns = ["centre", "low", "high", "rest", "reach", *_BITS]
    small = entries.where("head is not null").select("token", "block", *(F.col("head" if x == "rest" else x).alias(f"a_{x}") for x in columns))
    large = entries.select("token", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"), *(F.col(x).alias(f"b_{x}") for x in columns))
    sizes = (F.col("a_low") <= F.col("b_high")) & (100 * F.col("a_high") >= percent * F.col("b_low"))
    fits = (100 + percent) * F.least("a_rest", "b_rest") >= percent * (F.col("a_low") + F.col("b_low"))
    most = most_apart("a_high", "b_high", percent) + F.col("a_reach") + F.col("b_reach")
    found = small.join(large, ["token", "block"]).where((F.col("a_centre") != F.col("b_centre")) & sizes & fits & (_apart("a_", "b_") <= most))
    found = found.groupBy(F.least("a_centre", "b_centre").alias("a"), F.greatest("a_centre", "b_centre").alias("b")).agg(F.max(most).alias("most"))
    out = materialise(found, "near")
    discard(entries)
    return out


def overlaps(asked: list[np.ndarray], held: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, table) of how many values each of asked[from:to] has in common with each of `held`."""
    sizes = np.array([x.size for x in held])
    values = np.concatenate([*held, np.empty(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(held)), sizes)[order]
    ranges = [(np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")) for x in asked]
    hits = np.array([int((hi - lo).sum()) + len(held) for lo, hi in ranges])
    start = 0
    while start < len(asked):
        end = start + max(1, int(np.searchsorted(np.cumsum(hits[start:]), CELLS, "right")))
        table = np.zeros((min(end, len(asked)) - start, len(held)), np.int64)
        for i in range(table.shape[0]):
            lo, hi = ranges[start + i]
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            table[i] = np.bincount(owner[at], minlength=len(held))
        yield start, start + table.shape[0], table
        start += table.shape[0]


def star_links(near: DataFrame, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """c, links (documents of other classes), other (c itself or a class that links reach): a row or two for each class and star.

    `near` has the differing shingles of pairs of centres, `classes` c, n and w (the number of documents)."""
    alone = members.select("c", "centre").hint("merge").join(classes, "c", "right").withColumn("centre", F.coalesce("centre", "c"))
    full = classes.select("c", "n", "w").join(members.hint("merge"), "c", "left").select(F.coalesce("centre", "c").alias("centre"), "c", "n", "w", F.coalesce("differ", F.array().cast("array<long>")).alias("differ"))
    size = alone.groupBy("centre").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    host = lambda n: size.select(F.col("centre").alias(n), *(F.col(x).alias(f"{x}_{n}") for x in ("size", "n", "w")))
    sized = near.hint("merge").join(host("a"), "a").hint("merge").join(host("b"), "b")
    lone = F.expr("size_a = 1 and size_b = 1")
    links = lone & (F.size("differ") <= most_apart("n_a", "n_b", percent))
    direct = sized.where(links).select(F.explode(F.array(*(F.struct(F.col(x).alias("c"), F.col(f"w_{y}").alias("links"), F.col(y).alias("other")) for x, y in ("ab", "ba")))).alias("x")).select("x.*")
    # the smaller of two stars asks the larger one
    turned = sized.where(~lone).select(F.when(F.expr("size_a >= size_b"), F.col("a")).otherwise(F.col("b")).alias("host"), F.when(F.expr("size_a >= size_b"), F.col("b")).otherwise(F.col("a")).alias("centre"), F.col("differ").alias("between"))
    crossed = turned.join(full, "centre").select("host", F.col("centre").alias("other"), "c", "n", "w", "differ", "between")
    large = size.where("size > 1").select("centre")
    inside = full.join(large, "centre")
    asked = crossed.union(inside.select("centre", "centre", "c", "n", "w", "differ", F.lit(None).cast("array<long>")))
    asked = materialise(asked.withColumn("weight", F.size("differ") + F.coalesce(F.size("between"), F.lit(0)) + 32), "asked")
    held = inside.select(F.col("centre").alias("host"), "c", "n", "w", "differ", (F.size("differ") + 32).alias("weight"))
    held = materialise(held.join(asked.select("host").distinct(), "host", "left_semi"), "held")
    weights = lambda df, name: df.groupBy("host").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias(name), F.sum("weight").alias(f"{name}_weight"))
    blocks = weights(held, "m").join(weights(asked, "q"), "host").withColumn("large", (F.col("m") > 1) | (F.col("q") > 1))
    # small stars share groups, as many of them as a block holds
    total = blocks.where("not large").agg(F.sum(F.col("m_weight") + F.col("q_weight"))).first()[0] or 0
    group = F.when(F.col("large"), F.col("host")).otherwise(F.pmod(F.xxhash64("host"), F.lit(-(-total // BLOCK) or 1)))
    blocks = blocks.select("host", "large", group.alias("part"), "m", "q")
    dealt = lambda df, own, other: df.join(blocks, "host").withColumns({"own": F.pmod(F.xxhash64("c", "host"), F.col(own)).cast("int"), "other_block": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
    keys = ["large", "part", "mb", "qb"]
    left = dealt(held, "m", "q").select(F.col("large").alias("own_large"), F.col("part").alias("own_part"), F.col("own").alias("own_mb"), F.col("other_block").alias("own_qb"), "host", "c", "n", "w", "differ")
    right = dealt(asked, "q", "m").select("large", "part", F.col("other_block").alias("mb"), F.col("own").alias("qb"), "host", "other", "c", "n", "w", "differ", "between")

    def count(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        held, asked = (x.sort_values("host", kind="stable", ignore_index=True) for x in (held, asked))
        hosts, first = np.unique(asked["host"].to_numpy(np.int64), return_index=True)
        own = held["host"].to_numpy(np.int64)
        (c, n, w), (q_c, q_n, q_w) = ([x[k].to_numpy(np.int64) for k in ("c", "n", "w")] for x in (held, asked))
        other, differ, q_differ, between = asked["other"].to_numpy(np.int64), held["differ"].to_numpy(), asked["differ"].to_numpy(), asked["between"].to_numpy()
        for host, a, b in zip(hosts, first, [*first[1:], len(asked)], strict=True):
            m = slice(int(np.searchsorted(own, host, "left")), int(np.searchsorted(own, host, "right")))
            if m.start == m.stop:
                continue
            has = [np.asarray(x, np.int64) for x in differ[m]]
            wants = [np.asarray(x, np.int64) if y is None else np.setxor1d(x, y, assume_unique=True).astype(np.int64) for x, y in zip(q_differ[a:b], between[a:b], strict=True)]
            d, q_d, into = np.array([x.size for x in has]), np.array([x.size for x in wants]), np.zeros(len(has), np.int64)
            group = np.arange(len(has))  # of held classes that links of the same asked ones join
            for i, j, table in overlaps(wants, has):
                q = slice(a + i, a + j)
                apart = q_d[i:j, None] + d[None] - 2 * table
                linked = (apart * (100 + percent) <= (100 - percent) * (q_n[q, None] + n[None, m])) & (q_c[q, None] != c[None, m])
                found = linked @ w[m]
                cross = other[q] != host
                into += q_w[q][cross] @ linked[cross]
                some = np.flatnonzero(found)
                for row in linked[some]:
                    joins = group[row]
                    if joins.max() != joins.min():
                        group[np.isin(group, joins)] = joins.min()
                out.append((q_c[q][some], found[some], c[m][linked[some].argmax(axis=1)]))
            some = (into > 0) | (group != np.arange(len(has)))
            out.append((c[m][some], into[some], c[m][group[some]]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("c", "links", "other"), columns, strict=True)))

    counted = left.groupBy(*(f"own_{k}" for k in keys)).cogroup(right.groupBy(*keys)).applyInPandas(count, "c long, links long, other long")
    out = materialise(counted.union(direct), "counted")
    discard(asked, held)
    return out


def _joined(documents: DataFrame, words: int, percent: int, lower: bool) -> DataFrame:
    """doc_id, source (hash of the text), n, class_id, component_id, first (the component's least doc_id and source), n_links."""
    bound_batches(documents.sparkSession)
    docs = prefixes(documents, frequent_shingles(documents, words, lower), words, percent, lower)
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    key = ["n", "sum1", "sum2"]
    same = docs.where("n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "source", "row")).alias("first"), F.count("*").alias("w"))
    same = materialise(same.select(*key, F.col("first.row").alias("c"), F.struct("first.doc_id", "first.source").alias("first"), "w"), "classes")
    heads = docs.join(same.select(F.col("c").alias("row")), "row", "left_semi").withColumnRenamed("row", "c")
    shared = shared_lists(heads)
    members = stars(shared, heads, documents, words, percent, lower)
    pairs = near_stars(shared, members, heads, percent)
    discard(shared)
    near = differences(pairs, heads, documents, words, lower)
    counted = star_links(near, members, same.select("c", "n", "w"), percent)
    edges = counted.where("c <> other").select(F.col("c").alias("a"), F.col("other").alias("b"))
    labels = connected_components(edges, materialise, drop=discard)
    linked = same.select("c", "first").join(labels, F.col("c") == F.col("node")).select("c", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    found = linked.join(least, "component").join(counted.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").select("c", "least", "links")
    classed = same.join(found, "c", "left").select(*key, F.col("first.doc_id").alias("class_id"), F.coalesce("least", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = docs.select("doc_id", "source", *key).join(classed, key, "left")
    return out.select("doc_id", "source", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("first", F.struct("doc_id", "source")).alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(documents: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, class_id (the least doc_id with the same set), component_id (the least that links reach), n_links
    (the number of other documents that the document links with)."""
    return _joined(documents, words, percent, lower).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id", "n_links")


def representatives(documents: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """All columns of `documents`; of each component the row of the least doc_id (then least hash of the text and of the whole row).
    Documents without a shingle and rows without an id stay."""
    one, source, id_, rank = (unused(documents, x) for x in ("near_one", "near_source", "near_id", "near_rank"))
    joined = _joined(documents, words, percent, lower)
    kept = joined.where((F.col("n") == 0) | (F.struct("doc_id", "source") == F.col("first"))).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source)).agg((F.max("n") > 0).alias(one))
    text = F.xxhash64(F.col("text").cast("string"))
    with_id = documents.where(F.col("doc_id").isNotNull())
    rows = with_id.join(kept, (with_id["doc_id"].cast("long") == F.col(id_)) & (text == F.col(source)))
    order = F.xxhash64(*(F.to_json(F.struct(c)) for c in (with_id[x] for x in documents.columns)))
    rows = rows.withColumn(rank, F.when(F.col(one), F.row_number().over(Window.partitionBy(id_, source).orderBy(order))).otherwise(1))
    return rows.where(F.col(rank) == 1).select(documents.columns).union(documents.where(F.col("doc_id").isNull()))
