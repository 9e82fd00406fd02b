"""Exact stratified hold-out and folds, seeded and distributed.

Rows are ranked inside their class by ``md5(key ':' seed)`` with the skew-proof ranking
of :mod:`panelstats.operators.ranking`.  Class quotas come from a table with one row per
class, computed as scikit-learn's stratified shuffle split does: the training size is
``n - ceil(share * n)``, each class gets the floor of its exact training share, the
leftover rows go to the largest remainders (ties: class name), and the test quota is the
rest of the class.  The first ``test quota`` rows of a class in hash order form its test
set.  Proportions match the source's split; its NumPy shuffle itself is not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.operators.ranking import ranked_in_groups
from panelstats.session import maybe_broadcast, small_table


def seeded_hash(key: str | Column, seed: int):
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f":{seed}")))


def _hash_ranked(df: DataFrame, key: str | Column, cls: str, seed: int):
    return ranked_in_groups(df, [cls], seeded_hash(key, seed), [key], rank_col="_rank")


def split_quotas(sizes: DataFrame, cls: str, test_share: float) -> DataFrame:
    """Per-class train/test quotas from the per-class sizes table (a few rows)."""
    everything = Window.partitionBy()
    n = F.sum("group_n").over(everything)
    n_train = n - F.ceil(F.lit(float(test_share)) * n)
    q = sizes.select(cls, "group_n", (F.col("group_n").cast("double") * n_train.cast("double")
                                      / n.cast("double")).alias("_cont"), n_train.alias("_n_train"))
    q = q.select("*", F.floor("_cont").alias("_floor"))
    q = q.select("*", (F.col("_cont") - F.col("_floor")).alias("_rem"),
                 (F.col("_n_train") - F.sum("_floor").over(everything)).alias("_need"))
    order = Window.orderBy(F.desc("_rem"), F.asc_nulls_first(cls))
    q = q.select("*", F.row_number().over(order).alias("_r"))
    train = F.col("_floor") + F.when(F.col("_r") <= F.col("_need"), 1).otherwise(0)
    return q.select(cls, F.col("group_n").alias("class_n"), train.cast("long").alias("train_n"),
                    (F.col("group_n") - train).cast("long").alias("test_n"))


def stratified_split(df: DataFrame, key: str, cls: str, test_share: float = 0.3, seed: int = 667,
                     split_col: str = "split") -> DataFrame:
    """Every row with ``split`` = ``'train'`` or ``'test'``; ``key`` must be unique."""
    ranked, sizes = _hash_ranked(df, key, cls, seed)
    quotas, small = small_table(split_quotas(sizes, cls, test_share))
    qt = quotas.select(F.col(cls).alias("_qc"), "test_n")
    joined = ranked.join(maybe_broadcast(qt, small), ranked[cls].eqNullSafe(qt["_qc"]), "inner")
    split = F.when(F.col("_rank") <= F.col("test_n"), F.lit("test")).otherwise(F.lit("train"))
    return joined.select(*df.columns, split.alias(split_col))


def stratified_folds(df: DataFrame, key: str | Column, cls: str, k: int = 5, seed: int = 667,
                     fold_col: str = "fold") -> DataFrame:
    """Every row with a fold number ``0..k-1``, stratified by class; ``key`` is a column or computed
    from some.

    Classes laid end to end (sorted by name), rows in hash order, position modulo ``k``:
    the per-fold per-class counts equal scikit-learn's ``StratifiedKFold`` allocation, so
    fold sizes differ by at most one overall and inside each class.
    """
    ranked, sizes = _hash_ranked(df, key, cls, seed)
    before = Window.orderBy(F.asc_nulls_first(cls)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(cls).alias("_oc"),
                           F.coalesce(F.sum("group_n").over(before), F.lit(0)).alias("_offset"))
    offsets, small = small_table(offsets)
    joined = ranked.join(maybe_broadcast(offsets, small), ranked[cls].eqNullSafe(offsets["_oc"]), "inner")
    fold = F.pmod(F.col("_offset") + F.col("_rank") - 1, F.lit(k)).cast("int")
    return joined.select(*df.columns, fold.alias(fold_col))


def fold_rows(folds: DataFrame, k: int, held_out: bool = True, fold_col: str = "fold") -> DataFrame:
    """Rows of fold ``k`` (``data[idx, ]``) or all the others (``data[-idx, ]``)."""
    c = F.col(fold_col)
    return folds.where(c == k if held_out else c != k)


def split_sizes(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return split_df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
