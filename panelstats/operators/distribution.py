"""Distribution tables behind the box, scatter and correlation views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.functions.repair import nan_to_null
from panelstats.operators.ranking import selected_quantiles
from panelstats.session import maybe_broadcast, small_table, written

_BOX = [(0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max")]


def _box_input(df: DataFrame, by: Sequence[str], value: str, keep: Sequence[str] = ()) -> DataFrame:
    """The narrow ``(keep, by, _v)`` input.  Rows without a group or without a value are not
    drawn (pandas/seaborn drop them)."""
    cols = list(keep) + [g for g in by if g not in keep]
    src = df.select(*cols, nan_to_null(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    for g in by:
        src = src.where(F.col(g).isNotNull())
    return src


def _fences(src: DataFrame, by: Sequence[str], whis: float) -> DataFrame:
    """Per group: n, min, quartiles, max and the whisker fences."""
    q = selected_quantiles(src, by, "_v", [p for p, _ in _BOX])
    stats = q.select(*by, F.col("group_n").alias("n"), *[F.col(f"_q{i}").alias(name) for i, (_, name) in enumerate(_BOX)])
    iqr = F.col("q3") - F.col("q1")
    return stats.select("*", iqr.alias("iqr"), (F.col("q1") - F.lit(whis) * iqr).alias("lower_fence"),
                        (F.col("q3") + F.lit(whis) * iqr).alias("upper_fence"))


def box_stats(df: DataFrame, by: Sequence[str], value: str, whis: float = 1.5) -> DataFrame:
    """Box-plot statistics of ``value`` per group.

    The (group, value) input is stored once; quartiles are selected from it without sorting, and
    the whiskers are one partial aggregate over it.  Quartiles are exact, interpolated
    at ``(n-1)p`` (seaborn/matplotlib).  Whiskers are the most extreme values inside
    ``[q1 - whis*iqr, q3 + whis*iqr]``.  One row per group with values: ``n min q1 median q3
    max iqr lower_fence upper_fence whisker_low whisker_high n_outliers``.
    """
    by = list(by)
    src = written(_box_input(df, by, value), "box-input")
    fences, small = small_table(_fences(src, by, whis))
    f = fences.select(*by, "lower_fence", "upper_fence")
    inside = (F.col("_v") >= F.col("lower_fence")) & (F.col("_v") <= F.col("upper_fence"))
    whiskers = (src.join(maybe_broadcast(f, small), by, "inner")
                .groupBy(*by)
                .agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
                     F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
                     F.sum(F.when(~inside, 1).otherwise(0)).alias("n_outliers")))
    out = fences.join(whiskers, by, "left")
    return out.select(*by, F.col("n").cast("long").alias("n"), "min", "q1", "median", "q3", "max",
                      "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high",
                      F.coalesce(F.col("n_outliers"), F.lit(0)).cast("long").alias("n_outliers"))


def box_outliers(df: DataFrame, by: Sequence[str], value: str, keep: Sequence[str] = (),
                 whis: float = 1.5) -> DataFrame:
    """Every row outside its group's fences, with the fences and the side."""
    by = list(by)
    src = written(_box_input(df, by, value, keep), "box-input")
    fences, small = small_table(_fences(src, by, whis))
    f = fences.select(*by, "lower_fence", "upper_fence")
    rows = src.join(maybe_broadcast(f, small), by, "inner")
    side = F.when(F.col("_v") < F.col("lower_fence"), F.lit("low")).when(
        F.col("_v") > F.col("upper_fence"), F.lit("high"))
    return (rows.where(side.isNotNull())
                .select(*keep, *[g for g in by if g not in keep], F.col("_v").alias(value),
                        "lower_fence", "upper_fence", side.alias("side")))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregate pass.

    Output ``(feature_a, feature_b, corr)`` for all ordered pairs including the diagonal;
    each unordered pair is computed once and mirrored.
    """
    cols = list(cols)
    clean = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.agg(*[F.corr(clean[cols[i]], clean[cols[j]]).alias(f"_c{i}_{j}") for i, j in pairs])
    cells = []
    for i, j in pairs:
        cells.append(F.struct(F.lit(cols[i]).alias("feature_a"), F.lit(cols[j]).alias("feature_b"),
                              F.col(f"_c{i}_{j}").alias("corr")))
        if i != j:
            cells.append(F.struct(F.lit(cols[j]).alias("feature_a"), F.lit(cols[i]).alias("feature_b"),
                                  F.col(f"_c{i}_{j}").alias("corr")))
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str],
         variable_col: str = "variable", value_col: str = "value") -> DataFrame:
    """Wide to long, NULL values kept as pandas ``melt`` keeps NaN."""
    return df.unpivot(list(ids), list(values), variable_col, value_col)


def guarded_melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], guard_col: str,
                 max_value: float) -> DataFrame:
    """Filter on one column first, then melt all of them (F4 then R1).

    The guard is applied before the ``Expand``, so over a stored table it reaches the scan; a
    filter on the ``variable`` column after the melt would not.
    """
    from panelstats.operators.missing import range_guard
    return melt(range_guard(df, guard_col, max_value), ids, values)


def scatter_bins(df: DataFrame, x: str, y: str, color: str, x_width: float, y_width: float) -> DataFrame:
    """A scatter of two scores by class as a 2-D histogram: one row per occupied cell.

    Cells are ``[k*width, (k+1)*width)``; rows with a missing coordinate are not drawn.
    """
    xb = F.floor(nan_to_null(F.col(x).cast("double")) / F.lit(x_width))
    yb = F.floor(nan_to_null(F.col(y).cast("double")) / F.lit(y_width))
    cells = (df.select(F.col(color), xb.alias("x_bin"), yb.alias("y_bin"))
               .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
               .groupBy(color, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))
    return cells.select(color, F.col("x_bin").cast("long").alias("x_bin"),
                        F.col("y_bin").cast("long").alias("y_bin"),
                        (F.col("x_bin") * F.lit(x_width)).alias("x_low"),
                        (F.col("y_bin") * F.lit(y_width)).alias("y_low"), "n")
