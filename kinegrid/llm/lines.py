"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text's lines are hashed, and a hash rolls over each `least` consecutive ones. Several chunkings read bits of their own of
that hash: half of its values both open a chunk at the window's first line and close it at its last, an eighth only open, an
eighth only close, the rest are inside. A chunk runs from an opening window to the next closing one if no other mark lies
between. So its boundaries depend on its own lines alone, wherever they stand, and it has `least` lines or more; a passage
of only `least` lines is a chunk of its own in some chunking but for a share of 2^-chunkings, a longer one has chunks inside.

Chunks with equal hashes are laid over the place where they stand first (least doc_id, then line), overlapping ones as one
run, widened by `grow` lines at both ends. There the lines are compared byte by byte: of a run, stretches of `least` equal lines or
more go, so each line that goes stands earlier, too.

Rows: a null text stays null with 0 lines, an empty one has one empty line; texts are read whole; rows that repeat an id
and a text have one result, which each of them gets; rows without an id keep all lines; an empty table gives an empty result; other columns stay, but for
ones named as the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialise, unused

#: Buckets of 2^15 bits of a bitmap, 4 KB each: 8 MB in all at every size of the input.
BUCKETS = 1 << 11
#: Bits of the rolling hash that a chunking reads. Of their values those under BOTH open and close; OPENS and CLOSES do one of both.
_BITS, BOTH, OPENS, CLOSES = 3, 4, 4, 5


def chunks(text: Column, chunkings: int, least: int) -> Column:
    """Array of (start, length, hash) of a text's chunks, each once; start counts from 0. Null if it has under `least` lines."""
    hashes = F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))
    rolled = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - least + 1), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(least))))
    span = lambda start, end: F.struct(start.alias("start"), (end - start + least).alias("length"))
    value = lambda r, s: F.shiftright(r, s * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    #: the bit that is set in values that do not both open and close
    single = sum(BOTH << s * _BITS for s in range(chunkings))

    def longer(r: Column, s: int) -> Column:
        marks = F.filter(F.transform(r, lambda x, i: F.struct(i.alias("i"), value(x, s).alias("v"))), lambda m: m["v"] <= CLOSES)
        pairs = lambda m: F.zip_with(m, F.slice(m, F.lit(2), F.size(m)), lambda a, b: F.when((a["v"] == OPENS) & (b["v"] == CLOSES), span(a["i"], b["i"])))
        return F.filter(let(marks, pairs), lambda x: x.isNotNull())

    def spans(r: Column) -> Column:
        shortest = F.filter(F.transform(r, lambda x, i: F.when(x.bitwiseAND(F.lit(single)) != single, span(i, i))), lambda x: x.isNotNull())
        return F.concat(shortest, F.array_distinct(F.concat(*(longer(r, s) for s in range(chunkings)))))

    whole = lambda h: F.transform(let(rolled(h), spans), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.xxhash64(F.slice(h, s["start"] + 1, s["length"])).alias("hash")))
    return let(hashes, lambda h: F.when(F.size(h) >= least, whole(h)))


def with_mark(table: DataFrame, source: Column, marked: DataFrame, name: str) -> DataFrame:
    """`table` with a boolean column: true in rows whose doc_id and source are in `marked`, and in few or many others, as far as
    the bitmap is full. It is of one size, so it is broadcast, and texts that it excludes need not be shuffled."""
    bucket, bits = (unused(table, x) for x in ("mark_bucket", "mark_bits"))
    bit = lambda doc, source: F.pmod(F.xxhash64(doc, source), F.lit(BUCKETS << 15))
    bitmap = marked.select(bit(F.col("doc_id"), F.col("source")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(bits))
    own = bit(table["doc_id"], source)
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substr(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return table.join(F.broadcast(bitmap), F.bitmap_bucket_number(own) == F.col(bucket), "left").withColumn(name, is_set).drop(bucket, bits)


def runs(docs: DataFrame, chunkings: int, least: int, grow: int) -> DataFrame:
    """doc_id, source, start, length and first_id, first_source, first_start: the runs of chunks that stand earlier, too."""
    found = docs.select("doc_id", "source", F.explode(chunks(F.col("text"), chunkings, least)).alias("c")).select("doc_id", "source", "c.*")
    found = materialise(found, "chunks")
    place = F.struct("doc_id", "start", "source")
    first = found.groupBy("hash", "length").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "length", "first")
    # here and below both sides grow with the documents: merged at every size, not broadcast at small ones
    later = found.join(first.hint("merge"), ["hash", "length"]).where(place > F.col("first"))
    # chunks that lie equally far from where they stand first are of one run
    keys = ["doc_id", "source", "first_id", "first_source", "shift"]
    later = later.select("doc_id", "source", F.col("first.doc_id").alias("first_id"), F.col("first.source").alias("first_source"), (F.col("start") - F.col("first.start")).alias("shift"), F.sequence("start", F.col("start") + F.col("length") - 1).alias("rows"))
    covered = later.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rows")))).alias("rows"))
    at = lambda rows, i: F.element_at(rows, F.greatest(F.least(i, F.size(rows)), F.lit(1)))
    starts = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (at(rows, i) != x - 1))
    ends = lambda rows: F.filter(rows, lambda x, i: (i == F.size(rows) - 1) | (at(rows, i + 2) != x + 1))
    islands = let(F.col("rows"), lambda rows: F.zip_with(starts(rows), ends(rows), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    split = covered.select(*keys, F.explode(islands).alias("x"))
    start = F.col("x.a") - F.least(F.lit(grow), F.col("x.a"), F.col("x.a") - F.col("shift"))
    split = split.select(*keys, start.alias("start"), (F.col("x.b") + 1 + grow - start).alias("length"))
    out = materialise(split.select("doc_id", "source", "start", "length", "first_id", "first_source", (F.col("start") - F.col("shift")).alias("first_start")), "runs")
    discard(found)
    return out


def repeated_lines(docs: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """doc_id, source, gone: the places, from 1, of the lines of runs that are the same bytes where the run stands first."""
    side = ["doc_id", "source", "start", "length"]
    first = ["first_id", "first_source", "first_start", "length"]
    wanted = runs.select(*side).union(runs.select(*first)).groupBy("doc_id", "source").agg(F.collect_set(F.struct("start", "length")).alias("wanted"))
    part = lambda lines, w: F.struct(w["start"].alias("start"), w["length"].alias("length"), F.slice(lines, w["start"] + 1, w["length"]).alias("lines"))
    parts = let(F.split("text", "\n", -1), lambda lines: F.transform("wanted", lambda w: part(lines, w)))
    held = with_mark(docs, F.col("source"), wanted, "held").where("held").drop("held")
    pieces = held.join(wanted.hint("merge"), ["doc_id", "source"]).select("doc_id", "source", F.explode(parts).alias("p")).select("doc_id", "source", "p.*")
    pieces = materialise(pieces.groupBy(*side).agg(F.first("lines").alias("lines")), "pieces")  # rows may repeat an id and a text
    there = pieces.select(*(F.col(a).alias(b) for a, b in zip(side, first, strict=True)), F.col("lines").alias("there"))
    both = runs.join(there.hint("merge"), first).join(pieces.hint("merge"), side)
    same = F.zip_with("lines", "there", lambda a, b: F.coalesce(a == b, F.lit(False)))
    window = lambda e, i: F.forall(F.slice(e, i, F.lit(least)), lambda x: x)
    windows = lambda e: F.filter(F.sequence(F.lit(1), F.size(e) - least + 1), lambda i: window(e, i))
    found = let(same, lambda e: F.when(F.size(e) >= least, windows(e)))
    gone = both.select("doc_id", "source", F.transform(found, lambda i: F.sequence(F.col("start") + i, F.col("start") + i + least - 1)).alias("gone"))
    gone = gone.where(F.size("gone") > 0).select("doc_id", "source", F.array_distinct(F.flatten("gone")).alias("gone"))
    out = materialise(gone.groupBy("doc_id", "source").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone")), "gone")
    discard(pieces)
    return out


def dedup(documents: DataFrame, chunkings: int = 8, least: int = 2, grow: int = 2, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of `documents`, with the remaining text, and the columns n_lines and n_removed, or of other names (`counts`)."""
    if not 1 <= chunkings <= 64 // _BITS:
        raise ValueError(f"a rolling hash has bits for 1 to {64 // _BITS} chunkings")
    source = F.xxhash64("text")
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", source.alias("source"))
    found = runs(docs, chunkings, least, grow)
    gone = repeated_lines(docs, found, least)
    discard(found)
    id_, source_, gone_, some = (unused(documents, x) for x in ("line_id", "line_source", "line_gone", "line_some"))
    rows = with_mark(documents, source, gone, some)
    gone = gone.select(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("gone").alias(gone_))
    changed = rows.where(some).join(gone.hint("merge"), (F.col("doc_id") == F.col(id_)) & (source == F.col(source_)), "left").drop(id_, source_)
    joined = changed.unionByName(rows.where(~F.col(some)).withColumn(gone_, F.lit(None).cast("array<int>")))
    split = F.split("text", "\n", -1)
    left = let(split, lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(gone_)), lambda i: F.element_at(lines, i)), "\n"))
    kept = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(left)
    others = [c for c in documents.columns if c not in ("text", *counts)]
    return joined.select(*others, kept.alias("text"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias(counts[0]), F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias(counts[1]))
