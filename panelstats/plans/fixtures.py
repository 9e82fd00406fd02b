"""The driver's tables in the panel roles.

| role                    | table                 | columns                                     |
| ----------------------- | --------------------- | ------------------------------------------- |
| assessments             | lineitem              | point_id=l_orderkey, point=l_returnflag,    |
|                         |                       | rater=l_linenumber, status=l_linestatus,    |
|                         |                       | visit_ts=l_shipdate, four scores            |
| classes (class + geo)   | orders x customer     | point_id=o_orderkey, class=o_orderpriority, |
|                         |                       | status=o_orderstatus, lat=c_acctbal,        |
|                         |                       | lon=o_totalprice                            |
| ordered assessments     | events                | user_id, event_id (unique), value, ts, type |
| fixed predictions       | labels                | quality = label, toxic = prediction         |

The same views are spelled in SQL in :mod:`panelstats.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SCORES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# --- stand-ins for the five ordered classes: least to most severe, and the negatives
PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
PRIORITY_NEGATIVE = ["5-LOW", "4-NOT SPECIFIED"]

LINEITEM_NON_SCORES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                       "l_linestatus", "l_shipdate"]

# Line numbers repeat within an order; with the price in cents a row's place is unique.
ROW_ORDER = "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint)"

DIGITS = 6  # float outputs are compared at this many decimals
# Box statistics of 6-decimal inputs are exact at 9 decimals (quarter-point interpolation,
# then 1.5 x iqr), so rounding there never meets a tie that engines resolve differently.
BOX_DIGITS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("point_id"), F.col("l_returnflag").alias("point"),
                     F.col("l_linenumber").alias("rater"), F.col("l_linestatus").alias("status"),
                     F.col("l_shipdate").alias("visit_ts"), *SCORES)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return (o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
             .select(F.col("o_orderkey").alias("point_id"), F.col("o_orderpriority").alias("class"),
                     F.col("o_orderstatus").alias("status"), F.col("c_acctbal").alias("lat"),
                     F.col("o_totalprice").alias("lon")))


def named_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments in the source's full layout: a name that two ids share, a height as text, a
    species, a row order, and scores of which some are missing."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("point_id"), F.expr("concat('P', l_orderkey div 2)").alias("point"),
                     F.expr(ROW_ORDER).alias("seq"), F.col("l_shipdate").alias("visit_ts"),
                     F.col("l_returnflag").alias("species"), F.expr("cast(l_linenumber % 3 as string)").alias("height"),
                     "l_quantity", "l_extendedprice", F.when(F.col("l_discount") != 0.0, F.col("l_discount")).alias("l_discount"),
                     "l_tax")


def named_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class table with the shared names."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("point_id"), F.expr("concat('P', o_orderkey div 2)").alias("point"),
                    F.col("o_orderpriority").alias("class"))


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem scores with NULLs injected where a discount or tax is zero."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity",
                     F.when(F.col("l_discount") != 0.0, F.col("l_discount")).alias("l_discount"),
                     F.when(F.col("l_tax") != 0.0, F.col("l_tax")).alias("l_tax"))


def half_up(c, digits: int = DIGITS):
    """``floor(x * 10^d + 0.5) / 10^d``: plain IEEE operations, so two engines holding the
    same double always round it to the same double (``round`` itself differs between
    engines on ties such as 20.2083335)."""
    scale = F.lit(float(10 ** digits))
    return (F.floor(c * scale + F.lit(0.5)).cast("double") / scale)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, so engines that sum in another order still agree."""
    return df.select(*[half_up(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])
