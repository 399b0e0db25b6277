"""Odd rows and clashing columns, through every operator and every stage of the pipeline."""

import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import DOCS, ODD

import corpus_pipeline
from kinegrid.llm import bpe, jaccard, language, licences, lines, packing, pii, simhash, superkmers

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "classes": lambda df: jaccard.classes(df, 4, 85), "representatives": jaccard.representatives, "digest": pii.digest, "masked": pii.masked, "predict": lambda df: language.predict(df, language.train(df)), "chunks": lines.dedup,
    "bpe": lambda df: bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN), "windows": superkmers.remove_repeats, "licences": licences.scan, "simhash": simhash.edited_fingerprints, "packing": lambda df: packing.pack(df, VOCABULARY, public_tokenizers.PATTERN, added=True),
}
#: Columns that the operators name so inside, or add.
NAMES = [
    "n", "c", "row", "first", "token", "pos", "entries", "centre", "differ", "w", "near_one", "near_source", "near_id", "near_rank", "class_id", "component_id", "line_id", "line_source", "line_gone", "n_lines", "n_removed", "gone", "start", "length", "hash", "span_id", "span_source", "spans", "kind",
    "end", "value", "base", "lang_pred", "score", "letters", "minimiser", "digest", "packed", "piece", "bucket", "rank", "sequence_id", "offset", "next_id", "half0", "sha", "n_near", "licences", "confidence", "_id", "_source", "_line_gone", "_spans", "one", "source_",
]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(500_000))
    assert len(long) > 2_500_000
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(3 * i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    rows += [(3, ODD[1], "en", "s", 1), (12, ODD[4], "en", "s", 1), (12, ODD[4], "fr", "t", 2)]  # repeated rows, and one that differs elsewhere
    rows += [(300, passage, "en", "s", 1), (300, passage + " end", "en", "s", 1), (300, "call me at a@b.de " + passage, "de", "s", 1), (300, None, None, None, None), (300, "", None, None, None)]  # one id, other texts
    rows += [(None, passage, "en", "s", 1), (None, None, None, None, None), (None, "", "en", None, 0)]
    rows += [(400, long, "en", "s", len(long)), (401, long, "en", "s", len(long)), (402, long + " x", "en", "s", 1), (403, "a" * 3_000_000, "en", "s", 1), (404, "\n" * 5000, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def told(df, columns=None):
    return sorted((tuple(r[c] for c in (columns or sorted(df.columns))) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, odd, name):
    plain = OPERATORS[name](odd)
    clashing = odd.select("*", *(F.lit(-7).alias(c) for c in NAMES))
    got = OPERATORS[name](clashing)
    keep = [c for c in plain.columns if name != "representatives" or c in ("doc_id", "text")]  # of rows that differ elsewhere any one stays
    want = told(plain, keep)
    assert told(got, keep) == want
    kept = [c for c in NAMES if c in got.columns and c not in plain.columns]
    if kept:
        assert got.columns[: len(odd.columns)] and all(r[c] == -7 for r in got.select(kept).collect() for c in kept)
    ids = {r.doc_id for r in odd.select("doc_id").collect()}
    assert {r.doc_id for r in plain.select("doc_id").collect()} >= ids - {None} or name == "representatives"


def test_pipeline_keeps_the_columns_of_its_documents(spark, odd, tmp_path):
    docs = odd.select("*", *(F.lit(-7).alias(c) for c in NAMES))
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = docs.collect()
        assert all(r[c] == -7 for r in rows for c in NAMES)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 8
    # of the long texts one is left, of the id with several texts its near copies are one
    texts = [r.text for r in rows]
    assert sum(t.startswith("w0 w1 w4") for t in texts) == 1
    stage = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect()} == {r.doc_id for r in rows}


def test_repeated_ids_with_other_texts_of_windows(spark):
    """Each text of an id is a text of its own, in the order of the texts' hashes."""
    import hashlib

    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a {passage} b"), (1, f"c d e {passage}"), (1, "short"), (1, f"{passage} {passage}"), (2, passage), (2, passage), (2, f"x {passage} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted({(r.doc_id, r.h, r.text) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()})
    seen, want = set(), {}
    for doc, _, text in order:
        w, gone = text.split(), set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= {*range(i, i + 20)}
            seen.add(key)
        want[doc, text] = (doc, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = sorted(tuple(r) for r in superkmers.remove_repeats(df).collect())
    assert got == sorted(want[r] for r in rows)


def test_texts_of_one_id_whose_short_hashes_collide(spark):
    """Two texts of an id are told apart though their 32-bit hashes are equal."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = spark.range(300_000).select(F.concat("id", F.lit(f" {passage}")).alias("text")).withColumn("h", F.hash("text"))
    pairs = texts.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").limit(1).collect()
    assert pairs
    a, b = pairs[0].a, pairs[0].b + " " + " ".join(f"q{i}" for i in range(40))
    short, rows = pairs[0].b, [(7, a), (7, pairs[0].b), (8, b)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in superkmers.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id == 8}
    assert len(short.split()) == 31 and got == {(8, 71): 31}
    both = superkmers.remove_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in both) == [0, 30]


def test_ids_of_other_types_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "some words to read here", "en"), (2, None, "en")], "doc_id int, text string, lang string")
    for name, operator in OPERATORS.items():
        assert operator(df).count() >= 2 or name == "simhash"
        assert operator(df.limit(0)).count() == 0
