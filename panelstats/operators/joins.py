"""Equi-joins on the point key.

No broadcast hints: the class table has one row per point, so at scale it is as large as the
profile and both sides are shuffled on the key.  Spark (and AQE at run time, from measured
sizes) turns a join into a broadcast only when one side is actually small, and splits the
partitions of hot keys, on either side.  Rows whose key is NULL match nothing; a left join
spreads them by a salt.  A key that is hot on both sides needs :func:`fan_out_join`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from panelstats.session import maybe_broadcast, small_table


# Rows of a key on a side, and pairs, beyond which a key is dealt to a grid of tasks.
HEAVY_ROWS, HEAVY_PAIRS = 65_536, 1 << 26
NULL_CELLS = 1024


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)``; in a left join the rows of NULL keys, which match nothing,
    are spread over the partitions by a hash of the row, so they are no hot key."""
    keys = list(keys)
    if how != "left":
        return left.join(right, keys, how)
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    cell = F.when(missing, 1 + F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema.fields if not isinstance(f.dataType, MapType)]),
                                      F.lit(NULL_CELLS))).otherwise(0).cast("long")
    other = right.withColumn("__cell", F.lit(0).cast("long"))
    return left.withColumn("__cell", cell).join(other, [*keys, "__cell"], "left").drop("__cell")


def fan_out_join(left: DataFrame, right: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS,
                 heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """Inner join on keys that may repeat on both sides.

    Keys are counted on each side by partial aggregates.  A key whose pairs exceed ``heavy_pairs``
    is heavy: its rows are cut into blocks of about ``heavy_rows`` by a hash of the row, a left block
    is sent to every right block, and each pair of blocks is a join key of its own, so the product
    is spread over a grid of tasks.  All other keys are joined plainly.  AQE alone splits a hot
    key on one side only and sends the whole other side of it to every part.
    """
    keys = list(keys)

    def counted(df, name):
        return df.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(
            F.col(name) > 1)
    pairs = F.col("__l").cast("double") * F.col("__r").cast("double")
    heavy, small = small_table(counted(left, "__l").join(counted(right, "__r"), keys).where(pairs > heavy_pairs).select(
        *keys, F.ceil(F.col("__l") / F.lit(heavy_rows)).cast("int").alias("__lb"), F.ceil(F.col("__r") / F.lit(heavy_rows)).cast("int").alias("__rb")))
    if heavy.isEmpty():
        return left.join(right, keys)
    table = maybe_broadcast(heavy, small)

    def block(df, own, others, mine, theirs):
        at = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, MapType)]), F.col(own))
        return (df.join(table, keys).withColumn(mine, at.cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("__lb", "__rb"))
    grid = block(left, "__lb", "__rb", "__i", "__j").join(block(right, "__rb", "__lb", "__j", "__i"), [*keys, "__i", "__j"]).drop("__i", "__j")
    light = left.join(table.select(*keys), keys, "left_anti").join(right, keys)
    return light.unionByName(grid)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on shared key names; one copy of each key in the output.

    A name-only key may match several rows on either side; the result then holds every
    matching pair, as an equi-join does (:func:`fan_out_join` spreads hot names).
    """
    return keyed_join(left, right, keys, how)


def join_label(profile: DataFrame, classes: DataFrame, keys: Sequence[str],
               label_cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join only the label columns of the class table; the rest is pruned at the scan."""
    return keyed_join(profile, classes.select(*keys, *label_cols), keys, how)


def join_with_suffixes(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                       lsuffix: str = "_left", rsuffix: str = "_right") -> DataFrame:
    """Join where non-key columns present on both sides get suffixes.

    Only colliding non-key columns are renamed; keys appear once, then the left's other
    columns, then the right's, as a pandas ``join(lsuffix=, rsuffix=)`` lays them out.
    """
    keys = list(keys)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    l2 = left.select(*[F.col(c).alias(c + lsuffix) if c in clash else F.col(c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(c + rsuffix) if c in clash else F.col(c) for c in right.columns])
    joined = keyed_join(l2, r2, keys, how)
    lcols = [c + lsuffix if c in clash else c for c in left.columns if c not in keys]
    rcols = [c + rsuffix if c in clash else c for c in right.columns if c not in keys]
    return joined.select(*keys, *lcols, *rcols)
