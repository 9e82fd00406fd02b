import random

import pytest

from pyspark.sql import functions as F

from panelstats.operators.distribution import (box_outliers, box_stats, correlation_matrix, guarded_melt,
                                               scatter_bins)
from panelstats.operators.ranking import exact_quantiles, ranked_in_groups


def test_quartiles_interpolate_at_n_minus_1(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 10, 20]], "g string, v double")
    q = {r["p"]: r["value"] for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    assert q == {0.25: 2.25, 0.5: 3.5, 0.75: 8.5}


def test_box_stats_whiskers_and_outliers(spark):
    vals = [1, 2, 3, 4, 10, 20]
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(vals)], "i int, g string, v double")
    r = box_stats(df, ["g"], "v").collect()[0]
    assert (r["q1"], r["median"], r["q3"], r["iqr"]) == (2.25, 3.5, 8.5, 6.25)
    assert r["upper_fence"] == 8.5 + 1.5 * 6.25 and r["whisker_high"] == 10.0 and r["whisker_low"] == 1.0
    assert r["n_outliers"] == 1
    out = box_outliers(df, ["g"], "v", keep=["i"]).collect()
    assert [(o["i"], o["side"]) for o in out] == [(5, "high")]


def test_quantiles_match_spark_percentile_and_survive_skew(spark):
    rnd = random.Random(7)
    # one class holds most rows; ties included
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)] + \
           [(c, rnd.random()) for c in "abc" for _ in range(50)] + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    ours = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    ref = df.where(F.col("v").isNotNull()).groupBy("g").agg(
        F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()
    for r in ref:
        for p, v in zip([0.1, 0.5, 0.9], r["q"]):
            assert abs(ours[(r["g"], p)] - v) < 1e-9


def test_rank_equals_row_number(spark):
    from pyspark.sql import Window
    rows = [(None if i % 4 == 3 else float(i % 4) * (-1.0 if i % 8 else 1.0) * 0.0 + i % 4, i // 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "g double, k int").withColumn("h", F.md5(F.col("k").cast("string")))
    ranked, sizes = ranked_in_groups(df, ["g"], "h", ["k"])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("h", "k")))
    assert (sorted((str(r["g"]), r["k"], r["rank"]) for r in ranked.collect())
            == sorted((str(r["g"]), r["k"], r["want"]) for r in want.collect()))
    assert {r["g"]: r["group_n"] for r in sizes.collect()} == {0.0: 500, 1.0: 500, 2.0: 500, None: 500}


def test_same_result_for_1_and_64_partitions(spark):
    df = spark.createDataFrame([(i % 4, float((i * 31) % 97)) for i in range(800)], "g int, v double")
    results = []
    for n in (1, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted(tuple(r) for r in box_stats(df, ["g"], "v").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_guard_before_melt_and_rowcount(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 7.0, 2.0), (3, None, 3.0)], "k int, a double, b double")
    m = guarded_melt(df, ["k"], ["a", "b"], "a", 6)
    assert sorted((r["k"], r["variable"], r["value"]) for r in m.collect()) == [(1, "a", 5.0), (1, "b", 1.0)]


def test_correlation_and_bins(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, "c") for i in range(10)], "x double, y double, c string")
    c = {(r["feature_a"], r["feature_b"]): r["corr"] for r in correlation_matrix(df, ["x", "y"]).collect()}
    assert abs(c[("x", "y")] - 1.0) < 1e-12 and c[("x", "y")] == c[("y", "x")] and len(c) == 4
    b = scatter_bins(df, "x", "y", "c", 5.0, 10.0).collect()
    assert sum(r["n"] for r in b) == 10


@pytest.mark.parametrize("buckets, place_rows", [(4096, 1 << 20), (4096, 10), (2, 3), (7, 0)])
def test_selected_quantiles_equal_sorted_ones(spark, buckets, place_rows):
    """Skewed, tied, extreme and tiny ranges; with few buckets every range is cut many times."""
    import numpy as np
    from panelstats.operators.ranking import selected_quantiles
    rng = np.random.default_rng(1)
    values = {"even": rng.random(300), "powers": 2.0 ** rng.integers(-200, 200, 200), "ties": rng.integers(0, 3, 300).astype(float),
              "extreme": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0]), "one": np.array([3.5]), "same": np.full(50, -2.0),
              "signed": np.array([-0.0, 0.0, -0.0, 1.0]), None: rng.normal(size=41), "hot": np.concatenate([np.full(400, 1.0), rng.normal(size=9)])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("even", None), ("even", float("nan")), ("gone", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in selected_quantiles(df, ["g"], "v", probs, buckets, place_rows).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        s = np.sort(vs)
        for i, p in enumerate(probs):
            at = (len(s) - 1) * p
            lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert got[g][f"_q{i}"] == lo + (hi - lo) * (at - np.floor(at))
        assert got[g]["group_n"] == len(s)
