"""Invariants of the profile, melt, mode and first-row operators, on generated data
(hypothesis) and on the whole sf0.001 tables, including a key that holds most rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from panelstats.operators.distribution import melt
from panelstats.operators.profile import first_row, mode_fill, mode_first_seen, profile
from panelstats.plans import fixtures as fx

cell = st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False))
rows = st.lists(st.tuples(st.integers(0, 4), cell, cell), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_profile_invariants_generated(spark, data):
    df = spark.createDataFrame(data, "k int, a double, b double")
    p = profile(df, ["k"], ["a", "b"], ["mean", "min", "max", "max_min_diff", "sd"]).collect()
    assert len(p) == len({r[0] for r in data})
    for r in p:
        for c in ("a", "b"):
            mn, mean, mx, rng = r[f"{c}_min"], r[f"{c}_mean"], r[f"{c}_max"], r[f"{c}_max_min_diff"]
            if mean is None:
                assert mn is None and mx is None
                continue
            assert mn - 1e-6 <= mean <= mx + 1e-6 and rng >= 0


def test_profile_invariants_whole_table(spark):
    p = profile(fx.assessments(spark, SMALL), ["point_id"], fx.SCORES, ["mean", "min", "max", "max_min_diff"])
    bad = p.where(" OR ".join(f"({s}_min > {s}_mean + 1e-9 OR {s}_mean > {s}_max + 1e-9 OR {s}_max_min_diff < 0)"
                              for s in fx.SCORES))
    assert bad.count() == 0


def test_melt_row_count(spark):
    p = profile(fx.assessments(spark, SMALL), ["point_id"], fx.SCORES, ["mean"])
    assert melt(p, ["point_id"], [f"{s}_mean" for s in fx.SCORES]).count() == p.count() * len(fx.SCORES)


def test_hot_key(spark):
    # one user holds most events: results equal a plain per-key computation
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "event_type", "value")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.lit(-1)).otherwise(F.col("user_id")))
    filled = mode_fill(hot, ["user_id"], "event_type", "event_id")
    assert filled.count() == hot.count()
    modes = {r["user_id"]: r["event_type"] for r in mode_first_seen(hot, ["user_id"], "event_type", "event_id").collect()}
    pdf = hot.toPandas()
    for uid, g in pdf.groupby("user_id"):
        g = g.sort_values("event_id")
        counts = g["event_type"].value_counts()
        top = counts[counts == counts.max()].index
        first_seen = g[g["event_type"].isin(top)].iloc[0]["event_type"]
        assert modes[uid] == first_seen
    firsts = {r["user_id"]: r["event_id"] for r in first_row(hot, ["user_id"], "event_id").collect()}
    assert firsts == pdf.groupby("user_id")["event_id"].min().to_dict()


def test_hot_key_path_inside_operators(spark):
    from panelstats.operators.joins import join_with_suffixes
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "event_type", "value")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.lit(-1)).otherwise(F.col("user_id")))
    users = hot.select("user_id").distinct().withColumn("value", F.lit(1.0))
    plain_fill = sorted(map(tuple, mode_fill(hot, ["user_id"], "event_type", "event_id").collect()))
    plain_join = sorted(map(tuple, join_with_suffixes(hot, users, ["user_id"], "left").collect()), key=repr)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        split_fill = sorted(map(tuple, mode_fill(hot, ["user_id"], "event_type", "event_id").collect()))
        split_join = sorted(map(tuple, join_with_suffixes(hot, users, ["user_id"], "left").collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert split_fill == plain_fill and split_join == plain_join
