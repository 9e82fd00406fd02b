"""Missing-value filters and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN for floating columns (pandas counts both as missing)."""
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def rows_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with a missing value in any of ``cols`` (default: all) (F1)."""
    cols = list(cols or df.columns)
    return df.where(reduce(or_, [_missing(df, c) for c in cols]))


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows complete in all of ``cols`` (default: all), as ``na.omit`` (F2)."""
    cols = list(cols or df.columns)
    return df.where(~reduce(or_, [_missing(df, c) for c in cols]))


def null_cell_counts(df: DataFrame) -> DataFrame:
    """``table(is.na(df))``: number of present and missing cells, one pass.

    Output ``(is_na boolean, n bigint)``, one row per value that occurs.
    """
    missing = reduce(lambda a, b: a + b,
                     [F.sum(_missing(df, c).cast("long")) for c in df.columns])
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), missing.alias("_missing"))
    cells = F.col("_rows") * F.lit(len(df.columns))
    long = totals.select(F.explode(F.array(
        F.struct(F.lit(False).alias("is_na"), (cells - F.col("_missing")).alias("n")),
        F.struct(F.lit(True).alias("is_na"), F.col("_missing").alias("n")))).alias("r"))
    return long.select("r.is_na", F.col("r.n").cast("long").alias("n")).where(F.col("n") > 0)


def range_guard(df: DataFrame, col: str, max_value: float) -> DataFrame:
    """Keep rows with ``col <= max_value``; NULL and NaN rows drop, as in pandas."""
    c = F.col(col)
    return df.where((c <= F.lit(max_value)) & ~F.isnan(c))
