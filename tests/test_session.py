"""Scratch tables and the spreading of small tables."""

from panelstats import session as S


def test_scratch_tables_go_with_the_block(spark):
    with S.scratch(spark):
        t = S.written(spark.range(7).toDF("x"), "gone")
        path = t.inputFiles()[0].rpartition("/")[0]
        assert t.count() == 7
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    kept = S.written(spark.range(3).toDF("x"), "kept")
    assert kept.count() == 3


def test_only_small_tables_are_spread(spark, monkeypatch):
    small = S.written(spark.range(100).toDF("x").coalesce(1), "small")
    assert S.spread_rows(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(S, "SPREAD_BYTES", 10)
    assert S.spread_rows(small).rdd.getNumPartitions() == 1
