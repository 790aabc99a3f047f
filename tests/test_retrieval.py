"""Pruned BM25 and blocked dense ranking against the plain forms and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import dense, retrieval


@pytest.mark.parametrize(("k", "share"), [(1, 0.05), (3, 0.0), (3, 0.5), (400, 0.2)])
def test_pruned_equals_plain(spark, k, share):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 200]))) for _ in range(150)] + [None, "w39 w39", *["w1 w38"] * 20]
    units = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "unit_id long, text string, block int, n int").repartition(3)
    asks = [" ".join(rng.choices(words, k=rng.choice([1, 4, 30]))) for _ in range(12)] + ["absent", "", "w0 absent", "w38 w1 w1"]
    wanted = retrieval.query_terms(spark.createDataFrame(list(enumerate(asks)), "query_id long, text string"))
    n = units.agg(F.count(F.lit(1)).alias("n"))
    index = retrieval.build_index(units)
    old = retrieval.postings(retrieval.corpus_terms(units))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["unit_id"], round(r["score"], 5)) for r in df.collect())
    want = rows(retrieval.sparse_topk(old, wanted, k, n))
    assert rows(retrieval.sparse_topk(index, wanted, k, n)) == want
    assert rows(retrieval.pruned_topk(index, wanted, k, n, share)) == want


def brute(vectors, queries, k):
    out = []
    for q, w in queries:
        scored = sorted((-round(float(np.dot(v, w)), 6), u) for u, v in vectors)
        out += [(q, i + 1, u, -s) for i, (s, u) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 7, 100])
def test_dense_blocks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "VECTORS", 60)
    monkeypatch.setattr(dense, "STEP", 9)
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.integers(-3, 4, 5) / 4).tolist()) for i in range(200)] + [(200 + i, [0.5] * 5) for i in range(40)]
    queries = [(i, (rng.integers(-3, 4, 5) / 4).tolist()) for i in range(30)]
    v = spark.createDataFrame([*vectors, (None, [1.0] * 5), (999, None)], "vec_id long, unit array<double>")
    q = spark.createDataFrame([*queries, (None, [1.0] * 5)], "query_id long, unit array<double>")
    got = retrieval.dense_topk(v, q, 4, most)
    assert sorted((r["query_id"], r["rank"], r["unit_id"], r["score"]) for r in got.collect()) == brute(vectors, queries, 4)
    assert retrieval.dense_topk(v, q.where("false"), 4, most).count() == 0 == retrieval.dense_topk(v.where("false"), q, 4, most).count()


def test_five_thousand_queries_without_a_cross_join(spark):
    q = spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("unit"))
    got = retrieval.dense_topk(q.select(F.col("query_id").alias("vec_id"), "unit"), q, 1)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "CoGroup" in plan
    assert got.where("query_id = unit_id or score = 1.0").count() == 5000


def test_copies_of_vectors_do_not_grow_with_the_square():
    assert [dense.blocks_of(n, 256, 24) for n in (100, 2560, 25_600, 256_000)] == [1, 10, 24, 24]
    assert dense.blocks_of(100 * dense.VECTORS, 256, 24) == 100


def test_cells_of_several_products(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERIES", 3)
    rows = spark.range(40).selectExpr("id AS vec_id", "array(cos(id), sin(id)) AS unit")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    got, want = (sorted(map(tuple, retrieval.dense_topk(rows, asked, 3, most=m).collect())) for m in (7, 4096))
    assert got == want and len(got) == 120


def test_index_counts_terms_of_a_key_without_a_table_of_them(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "staged", lambda df: df)
    units = spark.createDataFrame([(1, "b a b 7"), (1, "a c"), (2, ""), (3, None), (4, "z")], "unit_id long, text string")
    index = retrieval.build_index(units)
    rows = lambda df: sorted((r["unit_id"], r["term"], round(r["weight"], 12)) for r in df.collect())
    assert rows(index) == rows(retrieval.postings(retrieval.corpus_terms(units)))
    assert "HashAggregate(keys=[unit_id" not in index._jdf.queryExecution().executedPlan().toString().replace("ObjectHashAggregate", "")
