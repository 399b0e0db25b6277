"""Nearest neighbours against brute force, and the pipeline end to end."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import DOCS, corpus, documents

import corpus_pipeline
from kinegrid.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, more=()):
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)] + list(more), SCHEMA)


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(1500, 32)).astype(np.float32)
    data[100:160] = data[3]
    bad = [(5000, None, 0), (5001, [0.0] * 32, 0), (5002, [float("nan")] * 32, 0), (5003, [None] * 32, 0), (5004, [1.0], 0), (5020, [float("inf")] * 32, 0), (None, [1.0] * 32, 0)]
    got = ann.search(table(spark, data, bad).repartition(4), every=20, k=20).toPandas()
    exact = data.astype(np.float64)
    assert sorted(set(got.query_id)) == list(range(0, 1500, 20))
    hit = 0
    for query, rows in got.sort_values("rank").groupby("query_id"):
        scores = exact @ exact[query]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 12))) if i != query][:20]
        hit += len({*order} & {*rows.vec_id})
        assert list(rows["rank"]) == list(range(1, 21)) and query not in set(rows.vec_id)
        assert np.allclose(rows.score, scores[rows.vec_id], atol=1e-12)
        assert list(zip(-rows.score, rows.vec_id)) == sorted(zip(-rows.score, rows.vec_id))
        if query in range(100, 160):
            assert [*rows.vec_id] == [i for i in [3, *range(100, 160)] if i != query][:20]
    assert hit / len(got) >= 0.95


def test_few_candidates_and_none(spark):
    got = ann.search(table(spark, np.eye(5)), every=2, k=20).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 4, 2: 4, 4: 4}
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.search(table(spark, np.eye(1))).count() == 0


@pytest.mark.parametrize("substring", [8, 16])
def test_probing_finds_every_code_within_the_radius_once(spark, substring):
    rng = np.random.default_rng(2)
    m, n = 64 // substring, 300
    parts = rng.integers(0, 1 << substring, (n, m)).astype(np.int32)
    parts[1::2] = parts[::2] ^ (rng.random((n // 2, m)) < 0.4) * (1 << rng.integers(0, substring, (n // 2, m)))
    vectors = rng.normal(size=(n, 4))
    index = spark.createDataFrame([(i, [*map(float, v)], [*map(int, p)]) for i, (v, p) in enumerate(zip(vectors, parts))], "vec_id long, embedding array<double>, parts array<int>")
    for radius in (0, 3, 9, 17, 30, 64):
        asked = index.where("vec_id < 40").withColumn("query_id", F.col("vec_id") + 1000).withColumn("radius", F.lit(radius)).withColumn("floor", F.lit(float("-inf")))
        found = ann.probe(index, asked.withColumn("reach", ann.reaches(F.col("radius"), m)), substring, 2, n).collect()
        apart = np.bitwise_count(parts[:40, None] ^ parts[None]).sum(axis=2)
        assert sorted((r.query_id - 1000, r.vec_id) for r in found) == [(int(i), int(j)) for i, j in np.argwhere(apart <= radius)]


def test_many_shards_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    monkeypatch.setattr(ann, "SHARD_QUERIES", 7)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 16)).astype(np.float32)
    data[::3] = data[0] + rng.normal(size=(300, 16)).astype(np.float32) * 0.001
    got = ann.search(table(spark, data), every=20, k=10).toPandas()
    exact = data.astype(np.float64)
    hit = sum(len({*g.vec_id} & {*[i for i in np.argsort(-(exact @ exact[q])) if i != q][:10]}) for q, g in got.groupby("query_id"))
    assert len(got) == 450 and hit / len(got) >= 0.9


def test_odd_vectors(spark):
    """The commonest dimension counts, not the first row's; ids may repeat."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(40, 8))
    rows = [(0, [1.0, 2.0], 0), (20, [1.0], 0)] + [(i, [*map(float, v)], 0) for i, v in enumerate(data)] + [(7, [*map(float, data[7])], 1), (9, [*map(float, -data[9])], 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=20, k=50).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 39, 20: 39}
    both = got[got.vec_id == 9].set_index("query_id").score
    assert all(np.isclose(both[q], abs(data[9] @ data[q])) for q in (0, 20))


def test_lengths_that_differ(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(600, 16)) * rng.uniform(0.1, 5, (600, 1))).astype(np.float32).astype(np.float64)
    got = ann.search(table(spark, data), every=20, k=10).toPandas()
    hit = sum(len({*g.vec_id} & {*[i for i in np.argsort(-(data @ data[q])) if i != q][:10]}) for q, g in got.groupby("query_id"))
    assert hit / len(got) >= 0.9


def test_pipeline(spark, tmp_path):
    texts = corpus(11, 40)
    df = documents(spark, texts).withColumn("class_id", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "personal_data", "packing"]
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
        sizes.append(docs.count())
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(r.n_chars == len(r.text) and any(c.isalpha() for c in r.text) for r in rows.values())
    assert len({r.text for r in rows.values()}) == len(rows)
    assert not any("a.b@c.d.e" in r.text for r in rows.values()) and any("<EMAIL>" in r.text for r in rows.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
