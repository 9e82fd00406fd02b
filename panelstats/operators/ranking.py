"""Exact positions and quantiles inside groups that a hot group cannot serialise (used by
splits, folds and box statistics).  One plan and one formula at every size.

*Positions by a hash.*  Rows are dealt into cells by the leading digits of their hash.  A
row's position in its group is the number of the group's rows in earlier cells (a prefix sum
over one count per cell) plus its place in its own cell.  Only cells are sorted.

*Quantiles by selection* (:func:`selected_quantiles`).  Values are never sorted: a group's range is
cut into buckets, rows are counted per (group, bucket) with partial aggregates, and only the buckets
that hold a wanted rank are cut again, by their own least and greatest values.  A bucket of one
value is done; when few rows are left, their places are counted.  What is shuffled is bounded by
groups x buckets and the rows of wanted buckets.

*Positions of all values* (:func:`value_positions`), the way for so many groups that their ranges
are no small table.  Rows are first counted per (group, value), so equal values are one row however
many there are.  The counts are range-partitioned on (group, value) and written, each row
with its partition's number; a prefix sum over one total per (partition, group) and a running
sum within a partition give every value's last position in its group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.session import small_table, written

# Hexadecimal digits of the hash that name a cell: 16 ** 4 cells per group.
CELL_DIGITS = 4
# Buckets that a range is cut into, and the rows that may be left for counting places.
BUCKETS = 4096
PLACE_ROWS = 1 << 20


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def ranked_in_groups(df: DataFrame, group_cols: Sequence[str], hash_col: str | Column, ties: Sequence[str] = (),
                     rank_col: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Add the exact 1-based position of each row in its group by ``hash_col`` (hexadecimal
    text, evenly spread; a column or computed from some), then ``ties``.

    Returns ``(rows with rank_col, group sizes)``; the sizes table has the group columns and
    ``group_n``.  NULL group values form their own group; rows without a hash have no position and drop.
    The rows are shuffled once, without a computed hash: a cell's offset comes as a row of its own that is
    sorted before the cell's rows, so nothing is joined.
    """
    group_cols, hashed = list(group_cols), F.col(hash_col) if isinstance(hash_col, str) else hash_col
    cell = F.substring(hashed, 1, CELL_DIGITS)
    cells = written(df.groupBy(*group_cols, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")), "cells")
    before = Window.partitionBy(*group_cols).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*group_cols, F.col("_cell").alias("_ocell"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = df.where(hashed.isNotNull()).unionByName(offsets.where(F.col("_ocell").isNotNull()), allowMissingColumns=True)
    here = F.coalesce(F.col("_ocell"), cell)
    dealt = rows.repartition(here).withColumns({"_cell": here, "_hash": F.when(F.col("_ocell").isNull(), hashed)})
    # the offset's row is the first of its cell and counts as many rows as are before the cell
    within = Window.partitionBy(*group_cols, "_cell").orderBy(F.asc_nulls_first("_hash"), *ties).rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_rank", F.sum(F.coalesce("_offset", F.lit(1))).over(within)).where(F.col("_ocell").isNull())
    sizes = cells.groupBy(*group_cols).agg(F.sum("_n").alias("group_n"))
    return ranked.select(*df.columns, F.col("_rank").alias(rank_col)), sizes


def value_positions(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """One row per (group, value): group columns, ``_v``, ``_n`` (its rows), ``_upto`` (rows of
    the group up to and with it) and ``group_n``.  NULL and NaN values are ignored."""
    group_cols = list(group_cols)
    v = F.col(value_col).cast("double")
    counts = (df.select(*group_cols, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_n")))
    order = [F.col(g).asc_nulls_first() for g in group_cols] + [F.col("_v")]
    ranged = written(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "value-counts")
    names = [f"_g{i}" for i in range(len(group_cols))]
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    parts = (ranged.groupBy(*group_cols, "_part").agg(F.sum("_n").alias("_pn"))
             .select(*[F.col(g).alias(n) for g, n in zip(group_cols, names)], F.col("_part").alias("_ppart"),
                     F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_offset"), F.sum("_pn").over(whole).alias("group_n")))
    run = Window.partitionBy(*group_cols, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("_run", F.sum("_n").over(run))
    joined = running.join(parts, _same(group_cols, names) & (F.col("_part") == F.col("_ppart")))
    return joined.select(*group_cols, "_v", "_n", (F.col("_offset") + F.col("_run")).alias("_upto"), "group_n")


def quantile_columns(positions: DataFrame, group_cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Group columns, ``group_n`` and ``_q0 .. _qk``: the quantiles at ``(n - 1) p``, linearly
    interpolated (type 7), by one partial aggregate over :func:`value_positions`."""
    aggs, cols = [F.max("group_n").alias("group_n")], []
    for i, p in enumerate(probs):
        at = (F.col("group_n") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("_upto") >= F.floor(at) + 1, F.col("_v"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_upto") >= F.ceil(at) + 1, F.col("_v"))).alias(f"_hi{i}")]
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(f"_q{i}"))
    return positions.groupBy(*group_cols).agg(*aggs).select(*group_cols, "group_n", *cols)


def selected_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                       buckets: int = BUCKETS, place_rows: int = PLACE_ROWS) -> DataFrame:
    """The same columns as :func:`quantile_columns`, by selection.

    ``df`` is read a few times, so it should be a stored table.  NULL and NaN values are ignored;
    NULL group values form a group of their own.
    """
    group_cols, names = list(group_cols), [f"_g{i}" for i in range(len(group_cols))]
    v = F.col(value_col).cast("double")
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(group_cols, names)], v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # 0.0 for a negative zero: equal values have one place
    rows = rows.withColumn("_v", F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.col("_v")))
    groups, small = small_table(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("group_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    if not small:
        return quantile_columns(value_positions(df, group_cols, value_col), group_cols, probs)
    places = [((F.col("group_n") - 1) * F.lit(float(p))) for p in probs]
    ranks = F.array_distinct(F.array(*[f(at).cast("long") + 1 for at in places for f in (F.floor, F.ceil)]))
    # nodes: disjoint ranges of a group, with the rows before and in them and the ranks wanted of them
    nodes = groups.select(*names, F.lit(0).cast("long").alias("before"), F.col("group_n").alias("n"), "lo", "hi", ranks.alias("ranks"))
    # hi > lo never gives a zero width; halves keep the width of an extreme range finite
    width = F.col("hi") - F.col("lo")
    share = F.when(width == float("inf"), (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(
        (F.col("_v") - F.col("lo")) / width)
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int"))).otherwise(0)
    found = []
    while True:
        found.append(nodes.where("lo = hi").select(*names, F.explode("ranks").alias("rank"), F.col("lo").alias("at")))
        open_nodes = nodes.where("lo < hi")
        left = open_nodes.agg(F.sum("n")).first()[0] or 0
        if not left:
            break
        mine = [F.col(f"_o{i}") for i in range(len(names))]
        side = open_nodes.select(*[F.col(n).alias(f"_o{i}") for i, n in enumerate(names)], "before", "lo", "hi", "ranks")
        here = reduce(and_, [F.col(n).eqNullSafe(m) for n, m in zip(names, mine)], F.lit(True)) & F.col("_v").between(F.col("lo"), F.col("hi"))
        inside = rows.join(F.broadcast(side), here)
        if left <= place_rows:
            place = Window.partitionBy(*names, "lo").orderBy("_v")
            placed = inside.withColumn("rank", F.col("before") + F.row_number().over(place)).where(F.array_contains("ranks", F.col("rank")))
            found.append(placed.select(*names, "rank", F.col("_v").alias("at")))
            break
        cut = inside.groupBy(*names, F.col("lo").alias("node"), "before", "ranks", bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = Window.partitionBy(*names, "node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn(
            "ranks", F.filter("ranks", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n")))).where(F.size("ranks") > 0)
        nodes = written(cut.select(*names, "before", "n", "lo", "hi", "ranks"), "wanted-ranges")  # at most two per group and probability
    at_rank = written(reduce(DataFrame.unionByName, found), "ranks").join(
        F.broadcast(groups.select(*[F.col(n).alias(f"_o{i}") for i, n in enumerate(names)], "group_n")),
        reduce(and_, [F.col(n).eqNullSafe(F.col(f"_o{i}")) for i, n in enumerate(names)], F.lit(True)))
    aggs, cols = [F.max("group_n").alias("group_n")], []
    for i, p in enumerate(probs):
        at = (F.col("group_n") - 1) * F.lit(float(p))
        for f, end in ((F.floor, "lo"), (F.ceil, "hi")):
            aggs.append(F.max(F.when(F.col("rank") == f(at).cast("long") + 1, F.col("at"))).alias(f"_{end}{i}"))
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(f"_q{i}"))
    out = at_rank.groupBy(*names).agg(*aggs)
    return out.select(*[F.col(n).alias(g) for n, g in zip(names, group_cols)], "group_n", *cols)


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                    prob_col: str = "p", out_col: str = "value") -> DataFrame:
    """Exact quantiles per group, one row per group and probability, with the group's value
    count ``group_n``; groups without values are absent.  ``p = 0`` and ``p = 1`` give the
    minimum and maximum."""
    wide = selected_quantiles(df, group_cols, value_col, probs)
    cells = F.array(*[F.struct(F.lit(float(p)).alias(prob_col), F.col(f"_q{i}").alias(out_col)) for i, p in enumerate(probs)])
    return wide.select(*group_cols, "group_n", F.explode(cells).alias("_z")).select(*group_cols, "_z.*", "group_n")
