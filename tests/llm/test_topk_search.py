import math

import numpy as np
import pytest

from millrace.llm import topk_search


def brute(rows, k, asked):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[(i, tuple(math.floor(256 * x) for x in v))] = True
    out = []
    for q, v in ok:
        if not asked(q):
            continue
        scores = {(-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)}
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_table_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = topk_search.op2_topk_search(spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, lambda q: q % 50 == 0)


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 0.0]), (50, [-0.001, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v").repartition(3)
    vectors = topk_search.quantised(table)
    got = topk_search.top_k(vectors, vectors.filter("id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda q: q % 50 == 0)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0), 5).collect() == []


@pytest.mark.parametrize("block", [7, 1000])
def test_clusters_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    x = (centres[rng.integers(0, 10, 900)] + 0.1 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:110] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk_search.top_k(vectors, vectors.filter("id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda q: q % 50 == 0)


def test_large_components_are_exact_or_kept_within_bounds(spark):
    rows = [(0, [5e6, -5e6]), (1, [5e6, 5e6]), (2, [-5e6, 5e6]), (3, [2.0, 3.0]), (50, [3e9, 1.0]), (51, [1e300, 1e300])]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in topk_search.top_k(vectors, vectors.filter("id in (0, 50)"), 5).collect()}
    assert got[(0, 1)] == 0 and got[(0, 2)] == -2 * 1280000000**2 and got[(0, 3)] == 1280000000 * (512 - 768)
    assert got[(50, 51)] == (1 << 63) - 1 and len(got) == 10


def test_clustered_vectors_are_mostly_ruled_out():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32)) * 256
    x = np.floor(centres[rng.integers(0, 40, 8000)] + 5 * rng.normal(size=(8000, 32))).astype(np.int64)
    pivots = topk_search.choose_pivots(x[:2000].astype(float), topk_search.PIVOTS)
    table = topk_search.Table(np.arange(8000), x, float((x.astype(float) ** 2).sum(1).max()), pivots)
    for i in range(0, 8000, 400):
        want = sorted((-(x @ x[i]))[np.arange(8000) != i])[:5]
        assert [-s for s, _ in table.best(i, x[i], 5)] == want
    assert table.evaluated < 0.1 * table.asked
