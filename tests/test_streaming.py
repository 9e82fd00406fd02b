from pyspark.sql import functions as F

from conftest import SMALL
from panelstats.session import shared_path
from panelstats.streaming import start_repair_ingest


def test_stream_repairs_like_batch(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    raw = li.select("l_orderkey", "l_linenumber",
                    F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("string"))
                     .otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"))
    src, sink = shared_path(spark, "test", "src"), shared_path(spark, "test", "sink")
    raw.write.mode("overwrite").parquet(src)
    q = start_repair_ingest(spark, src, raw.schema, ["l_quantity"], sink, shared_path(spark, "test", "log"))
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == li.count()
    assert dict(out.dtypes)["l_quantity"] == "double"
    assert out.where(F.col("l_quantity").isNull()).count() == 0


def test_restart_takes_new_files_once(spark):
    src, sink, log = (shared_path(spark, "test", n) for n in ("src", "sink", "log"))
    for run in (1, 2):
        rows = [(run * 100 + i, f"{i}.5") for i in range(10)]
        spark.createDataFrame(rows, "k long, score string").write.mode("append").parquet(src)
        for _ in range(2):  # a run without new files adds nothing
            start_repair_ingest(spark, src, "k long, score string", ["score"], sink, log).awaitTermination(120)
        assert spark.read.parquet(sink).count() == run * 10
