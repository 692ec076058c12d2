from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import topk_search
from quillon.llm.topk_search import search_cell, top_k_search

_SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok) if a != b and len(c) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    f = lambda: float(np.float32(rng.gauss(0, 0.3)))
    return [(i, [f() for _ in range(dim)]) for i in range(n)]


def search(spark, rows, k=20):
    df = spark.createDataFrame(rows, _SCHEMA)
    return sorted(map(tuple, top_k_search(df.repartition(3), F.col("vec_id") % 20 == 0, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(400, 24)
    assert search(spark, rows) == brute(rows)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 90)
    assert search(spark, rows, 5) == brute(rows, 5)


def test_ties_and_odd_rows(spark):
    same = [0.5] * 8
    rows = [(i, same) for i in range(100)] + [(200, None), (220, [1.0, None] + same[:6]), (240, [float("nan")] * 8), (260, [float("inf")] * 8), (280, [1.0, 2.0]), (300, []), (320, []), (7, same), (0, same)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows[:1]) == [] and search(spark, []) == []


@pytest.mark.parametrize("strip", [8, 64])
def test_pruning_loses_nothing(monkeypatch, strip):
    monkeypatch.setattr(topk_search, "STRIP", strip)
    rng = np.random.default_rng(3)
    centres = rng.integers(-30, 30, (6, 32))
    x = (centres[rng.integers(0, 6, 500)] + rng.integers(-4, 5, (500, 32))).astype(float)
    q = x[::10]
    rows, ids, scores = search_cell(q, np.arange(0, 500, 10), x, np.arange(500), np.arange(500), 9)
    full = (q @ x.T).astype(int)
    for r in range(len(q)):
        expected = sorted((-s, j) for j, s in enumerate(full[r]) if j != 10 * r)[:9]
        assert list(zip(-scores[rows == r], ids[rows == r])) == expected


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 30)), rng.normal(size=(50, 30))
    before = np.full((40, 50), np.inf)
    for cuts in topk_search.cuts_of(30):
        bound = topk_search._statistics(a, cuts) @ topk_search._statistics(b, cuts).T
        assert (bound >= a @ b.T - 1e-9).all() and bound.mean() <= before.mean()
        before = bound


def test_large_finite_components(spark):
    """Beyond 32, 52 and 64 bits: exact order, scores clamped to what a long holds."""
    big = [1e12, 3e30, -3e30, 3e38, float(np.float32(16777217))]
    rows = [(i, [float(np.float32(big[(i + j) % 5] * (1 if i % 3 else -1))) if (i + j) % 4 == 0 else float(j) for j in range(6)]) for i in range(140)]
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert search(spark, rows) == sorted((q, r, c, clamp(s)) for q, r, c, s in brute(rows))
    doubles = spark.createDataFrame([(i, [1e300 * (i % 7 - 3), 1.0, float(i)]) for i in range(90)] + [(100, [1.7e308, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k_search(doubles, F.col("vec_id") % 20 == 0).collect()))
    assert got == sorted((q, r, c, clamp(s)) for q, r, c, s in brute([(r[0], r[1]) for r in doubles.collect() if r[0] < 100]))


def test_beyond_orders_like_integers():
    scores = [0, 5, -5, 2**63 - 1, -(2**63), 2**63, 2**63 + 1, 2**64, 10**40, 10**41, -(2**63) - 1, -(10**40), -(10**40) - 1, -(10**41)]
    key = lambda s: (min(max(s, -(1 << 63)), (1 << 63) - 1), topk_search._beyond(s))
    assert sorted(scores, key=key) == sorted(scores)


def test_most_pairs_never_reach_the_exact_product(spark):
    x = np.stack([np.floor(64 * np.array(r["embedding"], dtype=np.float64)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    asked = np.arange(0, len(x), 20)
    cell = topk_search.Cell(x[asked], x, asked)
    r, c = cell.survivors(0, len(asked), 20)
    assert len(r) < len(asked) * len(x) / 2
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(score, axis=1)[:, -20]
    left = np.zeros(score.shape, bool)
    left[r, c] = True
    assert left[score >= least[:, None]].all()


def test_clashing_columns(spark):
    rows = vectors(60, 8)
    df = spark.createDataFrame(rows, _SCHEMA)
    for name in ("uid", "dim", "vec", "qb", "cb", "query_id", "score", "rank", "beyond"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, top_k_search(df, F.col("vec_id") % 20 == 0).collect())) == brute(rows)
