from pyspark.sql import functions as F

from panelstats.operators.columns import drop_matching, matching_columns, score_columns
from panelstats.operators.joins import join_on, join_with_suffixes


def test_suffix_join(spark):
    left = spark.createDataFrame([(1, "p1", 2.0), (2, "p2", 3.0)], "PontoID int, Ponto string, s double")
    right = spark.createDataFrame([(1, "P1", "C")], "PontoID int, Ponto string, C string")
    out = join_with_suffixes(left, right, ["PontoID"], "left")
    assert out.columns == ["PontoID", "Ponto_left", "s", "Ponto_right", "C"]
    rows = {r["PontoID"]: r for r in out.collect()}
    assert rows[2]["Ponto_right"] is None and rows[1]["C"] == "C"


def test_name_only_join_fans_out(spark):
    a = spark.createDataFrame([("n", 1.0)], "Ponto string, s double")
    b = spark.createDataFrame([("n", "id1", "X"), ("n", "id2", "Y")], "Ponto string, PontoID string, c string")
    assert join_on(a, b, ["Ponto"]).count() == 2


def test_column_rules():
    class D:
        columns = ["Ponto", "PontoID", "admin_mean", "Altura_mean", "Altura_min", "Degrad_mean"]
    assert score_columns(D) == ["admin_mean", "Altura_mean", "Altura_min", "Degrad_mean"]
    assert matching_columns(D, ["min"]) == ["admin_mean", "Altura_min"]
    assert matching_columns(D, ["_min"], how="suffix") == ["Altura_min"]


def test_drop_matching(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "k int, a_mean double, a_min double, Degrad_mean double")
    assert drop_matching(df, ["min", "Degrad"]).columns == ["k", "a_mean"]


def test_null_keys_skip_the_shuffle_of_a_left_join(spark):
    from pyspark.sql import functions as F

    from panelstats.operators.joins import keyed_join
    big = spark.range(1000).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    other = spark.createDataFrame([(0, "a"), (100, "b"), (None, "c")], "k long, c string")
    for how in ("inner", "left", "right"):
        want = sorted(map(tuple, big.join(other, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, keyed_join(big, other, ["k"], how).collect()), key=repr) == want


def test_left_join_on_two_keys_keeps_unmatched(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (None, "x", 3.0)], "k int, n string, s double")
    b = spark.createDataFrame([(1, "x", "A"), (1, "x", "B")], "k int, n string, sp string")
    got = sorted(map(tuple, join_on(a, b, ["k", "n"], "left").collect()), key=repr)
    assert got == sorted([(1, "x", 1.0, "A"), (1, "x", 1.0, "B"), (1, "y", 2.0, None), (None, "x", 3.0, None)], key=repr)


def test_registered_joins_can_fail(spark):
    """An inner join in place of a left one, or a unique right side, would be seen."""
    import __spark_entry__ as E
    from conftest import SMALL
    q = E.queries()
    assert q["join_left_suffix"](spark, SMALL).where("class IS NULL").count() > 0
    assert q["join_left_two_keys"](spark, SMALL).where("status IS NULL").count() > 0
    fan = q["join_fanout"](spark, SMALL)
    assert fan.count() > fan.select("point", "l_quantity_mean", "l_tax_mean", "l_extendedprice_mean").distinct().count()


def test_names_hot_on_both_sides_are_dealt_to_a_grid(spark):
    from panelstats.operators.joins import fan_out_join
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, i) for i in range(900)], "k string, a long")
    right = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 60}" if i % 5 else None, i) for i in range(600)], "k string, b long")
    want = left.join(right, ["k"])
    got = fan_out_join(left, right, ["k"], heavy_rows=40, heavy_pairs=1000)
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    # the product of the hot name comes from many tasks
    hot = got.where("k = 'hot'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = fan_out_join(left, right, ["k"], heavy_rows=40, heavy_pairs=1000).where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 0.5 * hot.count()
    assert fan_out_join(left, right, ["k"]).exceptAll(want).count() == 0


def test_left_join_spreads_null_keys_and_reads_the_left_once(spark):
    from panelstats.operators.joins import join_on
    left = spark.createDataFrame([(None if i % 2 else i % 10, i) for i in range(400)], "k long, a long")
    right = spark.createDataFrame([(i, -i) for i in range(7)], "k long, b long")
    got = join_on(left, right, ["k"], "left")
    assert got.columns == ["k", "a", "b"] and got.exceptAll(left.join(right, ["k"], "left")).count() == 0
    assert got.count() == 400 and got.where("k IS NULL").count() == 200
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
