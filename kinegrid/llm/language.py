"""Language ID by n-gram filters: one Bloom filter whose slots are bitmasks of languages.

A look-up ANDs the slots of an n-gram and so returns all languages that contain it; the bits are counted by language over
a text, corrected for each language's false-positive rate, and the highest count decides.

Training counts n-grams of a bounded sample: at most `sample` different training texts of each language, those of the least hash. A
language's n-grams are those with a rate of `min_rate` or more in it (so at most 1 / min_rate of each order); a look-up
returns all languages of which that holds.

Rows: a null text or one without a letter is `und` with score 0; so is any text if nothing could be learned; texts are
read whole; repeated rows and rows without an id give a result each; equal texts have equal results; an empty table gives an
empty result; other columns are ignored, or stay (`keep`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import U64, bound_batches, discard, materialise, mix, slices

ORDERS = (3, 4)
#: Bytes of text that are predicted at once: the arrays of n-grams take some hundred times as much.
SLICE = 1 << 18
_SPACE = 0x20
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else _SPACE for b in range(128)]


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram keys, their rows) for each order, over the letters of each text with a space around it."""
    padded = np.insert(_KEEP[data], np.repeat(offsets, 2)[1:-1], _SPACE)
    ends = offsets + 2 * np.arange(offsets.size)
    key = np.zeros(padded.size, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > padded.size:
            return
        key = key[: padded.size - n + 1] << U64(8) | padded[n - 1 :].astype(U64)
        if n not in ORDERS:
            continue
        row = np.repeat(np.arange(offsets.size - 1), np.diff(ends))[: key.size]
        last = padded[n - 1 :]
        within = np.arange(key.size) + n <= ends[row + 1]
        gaps = (padded == _SPACE)[1:] & (padded == _SPACE)[:-1]
        gaps = np.concatenate([[0], np.cumsum(gaps)])
        within &= gaps[n - 1 :][: key.size] == gaps[: key.size]
        assert last.size == key.size
        yield key[within] | U64(n << 56), row[within]


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # (words, size): bit l % 64 of word l // 64 is language l
    hashes: int
    false_rate: np.ndarray
    prior: str

    def masks(self, keys: np.ndarray, word: int) -> np.ndarray:
        out, size = None, U64(self.slots.shape[1] - 1)
        for i in range(self.hashes):
            found = self.slots[word][mix(keys, i) & size]
            out = found if out is None else out & found
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) corrected counts, and the number of n-grams of each row."""
        rows = offsets.size - 1
        hits, total = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for keys, row in grams(data, offsets):
            total += np.bincount(row, minlength=rows)
            for word in range(self.slots.shape[0]):
                mask = self.masks(keys, word)
                for bit, k in enumerate(range(64 * word, min(64 * (word + 1), len(self.languages)))):
                    hits[:, k] += np.bincount(row, weights=(mask >> U64(bit) & U64(1)).astype(float), minlength=rows)
        return np.clip((hits - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None), total


def build_filter(entries: list[tuple[str, int]], totals: dict[str, int], bits_per_entry: int = 16, hashes: int = 3) -> LanguageFilter:
    languages = sorted(totals)
    size = 1 << max(10, (bits_per_entry * max(1, len({k for _, k in entries})) - 1).bit_length())
    slots = np.zeros((max(1, -(-len(languages) // 64)), size), U64)
    own: dict[str, list[int]] = {x: [] for x in languages}
    for name, x in entries:
        own[name].append(x)
    for k, language in enumerate(languages):
        keys = np.array(own[language], np.int64).view(U64)
        for i in range(hashes):
            slots[k // 64][mix(keys, i) & U64(size - 1)] |= U64(1 << k % 64)
    fill = np.array([(slots[k // 64] >> U64(k % 64) & U64(1)).mean() for k in range(len(languages))])
    return LanguageFilter(languages, slots, hashes, np.minimum(fill**hashes, 0.99), max(languages, key=lambda x: (totals[x], x)) if languages else "und")


def train(rows: DataFrame, sample: int = 2000, min_rate: float = 2e-5, most: int = 256) -> LanguageFilter:
    """From `rows` with text and lang. `sample` bounds the rows of each language that are read. More than `most` languages are an error:
    their filters would not fit one machine, and so many values are no languages."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = F.xxhash64("text")
    share = materialise(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")  # a row for each language
    if (n := share.count()) > most:
        raise ValueError(f"{n} values of lang, of {most} at most")
    # the share keeps about twice the bound, of equal texts one, and the window then the bound
    some = rows.join(F.broadcast(share), "lang").where((order.cast("double") / 2.0**64 + 0.5) * F.col("rows") <= 2 * sample + 20).select("lang", "text").distinct()
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(order, "text"))).where(F.col("at") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for a, _, data, offsets in slices(batch.column(1)):
                for keys, row in grams(data, offsets):
                    own = names[a + row]
                    for name in set(own):
                        found, n = np.unique(keys[own == name], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * found.size, pa.string()), pa.array((found >> U64(56)).astype(np.int32)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "n", "gram", "times"])

    counts = some.mapInArrow(count, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    rate = counts.withColumn("rate", F.col("times") / F.sum("times").over(Window.partitionBy("lang", "n")))
    kept = rate.where(F.col("rate") >= min_rate)  # at most 1 / min_rate for each language and order
    totals = {r["lang"]: r["rows"] for r in share.collect()}
    entries = [(r["lang"], r["gram"]) for r in kept.select("lang", "gram").collect()]  # of `most` languages at most
    discard(share)
    return build_filter(entries, totals)


def predict(documents: DataFrame, model: LanguageFilter, keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred, score: the share of the text's n-grams that the best language has, corrected. With `keep` all columns of
    `documents` stay (but for its own of these names, which `names` can change), and the texts need no join with the predictions."""
    names_out = [c for c in documents.columns if c not in names] if keep else ["doc_id", "text"]
    documents = documents.select([F.col(c).cast("string").alias(c) if c == "text" else F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in names_out])
    at = names_out.index("text")
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array([*model.languages, "und"], object)
        for batch in batches:
            # small slices, in and out: neither side ever holds a second whole batch of texts
            for a, b, data, offsets in slices(batch.column(at), SLICE):
                counts, grams_of = model.counts(data, offsets)
                letters = np.add.reduceat(np.append((_KEEP[data] != _SPACE) & (data < 128), False), offsets[:-1]) * (np.diff(offsets) > 0) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = any(x.isalpha() for x in batch.column(at)[a + int(i)].as_py() or "")
                if model.languages:
                    total, top = counts.sum(axis=1), counts.argmax(axis=1)
                    top[total == 0] = model.languages.index(model.prior)
                    share = np.minimum(1.0, counts.max(axis=1) / np.maximum(1, grams_of))
                else:
                    letters[:] = False
                    top, share = np.zeros(b - a, int), np.zeros(b - a)
                best = pa.array(labels[np.where(letters, top, len(model.languages))], pa.string())
                passed = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns if keep else 1)]
                yield pa.RecordBatch.from_arrays([*passed, best, pa.array(np.where(letters, share, 0.0))], names=[*(names_out if keep else names_out[:1]), *names])

    schema = StructType([*(documents.schema if keep else documents.schema[:1]), StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return documents.mapInArrow(run, schema)
