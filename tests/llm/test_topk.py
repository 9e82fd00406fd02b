"""Exact top-k search against all scores in plain Python."""

import math

import numpy as np
import pytest

from panelstats.llm import topk


def by_force(rows, k=20, every=20, scale=64):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q is None or q % every:
            continue
        found = sorted(((max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), 1 - 2**63), i) for m, (i, b) in enumerate(good) if m != n and len(a) == len(b)),
                       key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        out += [(q, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def spark_rows(df, **kw):
    return sorted((tuple(r) for r in topk.exact_top_k(df, **kw).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("seed_rows, chunk_rows", [(4096, 131072), (5, 40)])
def test_equals_all_scores(spark, seed_rows, chunk_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 24))
    rows = [(i, (centres[i % 4] + 0.3 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rows[40][1]) for i in range(60)]  # many equal scores
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert spark_rows(df, seed_rows=seed_rows, chunk_rows=chunk_rows) == by_force(rows)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (20, [0.5, -2.0, 1.0]), (None, [1.0, 2.0, 3.0]), (3, None), (4, [None, 1.0, 1.0]),
            (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (40, []), (8, [1.0]), (60, [2.0]), (9, [3e30, 1.0, 1.0]),
            (80, [1e30, -1e30, 3.0]), (10, [2e8, 1.0, 3.0]), (100, [2e8, 7.0, 9.0]), (-20, [0.01, 0.02, -0.01])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rid", topk.F.lit(1)).withColumn("seed", topk.F.lit("s")).withColumn("score", topk.F.lit(2))
    assert spark_rows(df) == by_force(rows)


def test_empty_table_and_long_vectors(spark):
    assert topk.exact_top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3000).astype(np.float32).tolist()) for i in range(41)]
    assert spark_rows(spark.createDataFrame(rows, SCHEMA), k=3) == by_force(rows, k=3)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_bounds_hold_at_every_resolution(d):
    rng = np.random.default_rng(d)
    a, b = (np.floor(64 * rng.normal(size=(50, d))) for _ in range(2))
    counts = topk.segment_counts(d)
    assert counts == sorted(counts)
    for s in counts:
        assert (topk.segment_statistics(a, s) @ topk.segment_statistics(b, s).T >= a @ b.T - 1e-6).all()


def test_smooth_vectors_are_pruned_early():
    """Series with few changes: one segment per vector leaves few pairs."""
    rng = np.random.default_rng(3)
    x = np.floor(64 * np.repeat(rng.normal(size=(400, 1)) * 5, 64, axis=1) + rng.normal(size=(400, 64)))
    score = x @ x.T
    tau = np.partition(score, -20, axis=1)[:, -20]
    bound = topk.segment_statistics(x, 1) @ topk.segment_statistics(x, 1).T
    assert (bound >= tau[:, None]).mean() < 0.2
