"""Collapse raters into one row per point, and the one-pass summaries.

All aggregates here are algebraic (partial aggregate before the shuffle), so a point or
class holding a third of all rows is pre-reduced on every map task instead of landing
whole in one reducer.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.functions.repair import nan_to_null

# stat name -> aggregate over a NaN-free column.  Names are the column suffixes.
STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "media": F.avg,
    "min": F.min,
    "max": F.max,
    "max_min_diff": lambda c: F.max(c) - F.min(c),
    "sd": F.stddev_samp,
    "count": F.count,
}


def profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
            stats: Sequence[str] | Mapping[str, Callable[[Column], Column]] = ("mean",),
            drop_null_keys: bool = True) -> DataFrame:
    """One row per key with ``<col>_<stat>`` for every column and stat.

    NaN is treated as missing.  Rows with a NULL key are dropped by default, as a pandas
    ``groupby`` does; ``drop_null_keys=False`` keeps a NULL group, as dplyr does.
    ``sd`` is the sample deviation: NULL for a single rater.
    """
    fns = dict(stats) if isinstance(stats, Mapping) else {s: STATS[s] for s in stats}
    src = df
    if drop_null_keys and keys:
        src = src.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    clean = {c: nan_to_null(c) for c in cols}
    exprs = [fn(clean[c]).alias(f"{c}_{name}") for c in cols for name, fn in fns.items()]
    return src.groupBy(*keys).agg(*exprs)


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: str, seq: str,
                    out: str | None = None) -> DataFrame:
    """Most frequent ``value`` per key; ties go to the value seen first by ``seq`` (A5).

    Two partial aggregates: ``(key, value) -> (n, first seq)`` then ``max_by`` on
    ``(n, -first seq)``.  NULL counts as a value, as R's ``unique``/``match`` do.
    """
    out = out or value
    counts = (df.groupBy(*keys, value)
                .agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first")))
    return counts.groupBy(*keys).agg(
        F.max_by(F.col(value), F.struct(F.col("_n"), -F.col("_first"))).alias(out))


_ZERO = {"string": "", "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00", "timestamp_ntz": "1970-01-01 00:00:00", "boolean": "false"}


def _never_null(df: DataFrame, key: str) -> list[Column]:
    """Two columns that stand for a key and are equal where it is equal or NULL on both sides."""
    kind = df.schema[key].dataType.simpleString()
    return [F.coalesce(F.col(key), F.lit(_ZERO.get(kind, "0")).cast(kind)), F.col(key).isNull()]


def mode_fill(df: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """Replace ``value`` by its per-key mode on every row; row count unchanged.

    The mode table has one row per key and is joined back on the keys themselves, null-safe,
    so NULL is a group, as in dplyr, and 0.0 and -0.0 are one.  AQE splits a hot key.  It is a left
    join on the mode table's own grouping columns: a reader that does not use ``value`` leaves it out.
    """
    own = [c for k in keys for c in _never_null(df, k)]
    names = [f"_mk{i}" for i in range(len(own))]
    modes = mode_first_seen(df.select(*[c.alias(n) for c, n in zip(own, names)], value, seq), names, value, seq, out="_mode")
    same = reduce(and_, [c == F.col(n) for c, n in zip(own, names)])
    return df.join(modes, same, "left").select(*[F.col("_mode").alias(c) if c == value else F.col(c) for c in df.columns])


def first_row(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The whole first row (by ``seq``) of every key (W2, dplyr ``distinct(.keep_all)``).

    ``min_by`` over a struct of the row is a partial aggregate: every map task sorts its own
    rows by key and passes on one row per key, so a hot key is never gathered in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def class_distribution(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """``value_counts``: rows per class, missing class excluded, largest first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(count_col))
              .orderBy(F.desc(count_col), F.asc(col)))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``select(...) %>% distinct()``."""
    return df.select(*cols).distinct()


def feature_ranges(df: DataFrame, cols: Sequence[str], feature_col: str = "feature") -> DataFrame:
    """Global min, max and mean per feature in one pass, one row per feature."""
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(c)
        aggs += [F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"), F.avg(v).alias(f"_avg{i}")]
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(feature_col), F.col(f"_min{i}").cast("double").alias("min"),
                 F.col(f"_max{i}").cast("double").alias("max"), F.col(f"_avg{i}").alias("mean"))
        for i, c in enumerate(cols)])).alias("r"))
    return long.select("r.*")
