
from panelstats.operators.missing import drop_any_null, null_cell_counts, range_guard, rows_any_null
from panelstats.operators.profile import (class_distribution, feature_ranges, first_row, mode_fill,
                                          mode_first_seen, profile)


def test_mode_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (1, 3, 1.0), (1, 4, 1.0)], "k int, seq int, v double")
    assert mode_first_seen(df, ["k"], "v", "seq").collect()[0]["v"] == 3.0
    df2 = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (1, 3, 3.0), (1, 4, 1.0)], "k int, seq int, v double")
    assert mode_first_seen(df2, ["k"], "v", "seq").collect()[0]["v"] == 1.0


def test_mode_fill_keeps_rows_and_null_group(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (None, 4, "c"), (None, 5, "c")],
                               "k int, seq int, v string")
    out = mode_fill(df, ["k"], "v", "seq")
    assert out.count() == 5
    got = sorted((str(r["k"]), r["v"]) for r in out.collect())
    assert got == [("1", "b"), ("1", "b"), ("1", "b"), ("None", "c"), ("None", "c")]


def test_mode_fill_takes_signed_zeros_as_one_key(spark):
    rows = [(0.0, 1, "a"), (-0.0, 2, "b"), (-0.0, 3, "b"), (None, 4, "c"), (float("nan"), 5, "d")]
    out = mode_fill(spark.createDataFrame(rows, "k double, seq int, v string"), ["k"], "v", "seq").collect()
    assert sorted((r["seq"], r["v"]) for r in out) == [(1, "b"), (2, "b"), (3, "b"), (4, "c"), (5, "d")]


def test_one_rater_profile(spark):
    df = spark.createDataFrame([("p", 4.0)], "k string, s double")
    r = profile(df, ["k"], ["s"], ["mean", "min", "max", "max_min_diff", "sd"]).collect()[0]
    assert (r["s_mean"], r["s_min"], r["s_max"], r["s_max_min_diff"], r["s_sd"]) == (4.0, 4.0, 4.0, 0.0, None)


def test_null_key_dropped_and_nan_skipped(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 9.0), ("a", 4.0)], "k string, s double")
    out = {r["k"]: r for r in profile(df, ["k"], ["s"], ["mean", "min", "max", "max_min_diff"]).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["s_mean"], out["a"]["s_min"], out["a"]["s_max"], out["a"]["s_max_min_diff"]) == (4.0, 4.0, 4.0, 0.0)
    nan = spark.createDataFrame([("x", float("nan")), ("x", 2.0), ("x", None)], "k string, s double")
    assert profile(nan, ["k"], ["s"]).collect()[0]["s_mean"] == 2.0


def test_first_row_per_key(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early"), ("b", 2, "only")], "k string, seq int, v string")
    got = {r["k"]: (r["seq"], r["v"]) for r in first_row(df, ["k"], "seq").collect()}
    assert got == {"a": (1, "early"), "b": (2, "only")}


def test_missing_value_filters(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, float("nan"))], "i int, v double")
    assert sorted(r["i"] for r in rows_any_null(df).collect()) == [2, 4]
    assert sorted(r["i"] for r in drop_any_null(df).collect()) == [1, 3]
    assert {(r["is_na"], r["n"]) for r in null_cell_counts(df).collect()} == {(False, 6), (True, 2)}
    assert [r["i"] for r in range_guard(df, "v", 6).collect()] == [1]


def test_distribution_and_ranges(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "c string")
    assert [(r["c"], r["n"]) for r in class_distribution(df, "c").collect()] == [("x", 2), ("y", 1)]
    nums = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    got = {r["feature"]: (r["min"], r["max"], r["mean"]) for r in feature_ranges(nums, ["a", "b"]).collect()}
    assert got == {"a": (1.0, 3.0, 2.0), "b": (10.0, 30.0, 20.0)}


def test_a_filled_column_that_is_not_read_costs_no_join(spark):
    """statistics of the other columns do not shuffle the rows for the fill."""
    df = spark.createDataFrame([(None, 0.0, "a", 1, 1.0), (None, -0.0, "b", 2, 2.0), (None, 0.0, "b", 3, 3.0), ("", 0.0, "c", 4, 4.0), ("", None, "d", 5, 5.0)],
                               "k string, z double, v string, s long, x double")
    filled = mode_fill(df, ["k", "z"], "v", "s")
    assert [r["v"] for r in filled.orderBy("s").collect()] == ["b", "b", "b", "c", "d"]
    plan = profile(filled, ["k", "z"], ["x"], ["media"], drop_null_keys=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Join" in filled._jdf.queryExecution().optimizedPlan().toString()
