"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """m: the least of each u and its neighbours (partial aggregation, no hot task)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(key, root) for every node of ``links`` (a, b); root is the least key of its component.

    Each round hooks a node's larger neighbours, then its smaller ones, onto the least key
    around it; rounds grow with the logarithm of a component's size.  Nothing is collected.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(written(_smallest(both), "least"), F.col("u") == F.col("__u")).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        least = written(_smallest(large), "least")
        joined = large.join(least, F.col("u") == F.col("__u"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("__u").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        new = written(small.distinct(), "small-star")
        if _same(edges, new):
            break
        edges = new
    roots = new.select("v").distinct().select(F.col("v").alias("key"), F.col("v").alias("root"))
    return new.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Equal edge sets: equal sums of two independent row hashes, and equal counts."""
    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                            F.sum(F.xxhash64(F.lit(1), "v", "u").cast("decimal(38,0)"))).first())
    return mark(a) == mark(b)
