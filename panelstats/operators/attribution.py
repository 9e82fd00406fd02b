"""Additive explanations: totals, ordered paths, text and global ranking
(A15, W3, O3, X9, X10, M15, M16).  Tree attribution itself (M14) is in
:mod:`panelstats.operators.treeshap`.

Input is a long table ``(id, feature, value, contribution, base)``: one row per scored
row and feature, ``base`` constant per id.  Groups are one id's features (a handful of
rows), so the per-id windows and ordered lists below are bounded by the feature count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats import constants as K
from panelstats.functions.scalar import format_fixed, format_percent, sigmoid


def attribution_total(contrib: DataFrame, id_col: str = "id", base: str = "base",
                      contribution: str = "contribution") -> DataFrame:
    """``base + sum(contributions)`` per id, as log-odds and probability."""
    t = contrib.groupBy(id_col).agg(F.max(base).alias("base"),
                                    F.sum(contribution).alias("_sum"))
    logodds = F.col("base") + F.col("_sum")
    return t.select(id_col, "base", logodds.alias("logodds"), sigmoid(logodds).alias("probability"))


def attribution_path(contrib: DataFrame, id_col: str = "id", feature: str = "feature",
                     base: str = "base", contribution: str = "contribution") -> DataFrame:
    """Contributions applied one by one, smallest magnitude first.

    ``(id, step, feature, contribution, logodds, probability)``: ``logodds`` is the base
    plus every contribution up to this step.  Ties in magnitude go by feature name.
    """
    order = [F.abs(F.col(contribution)), F.col(feature)]
    w = Window.partitionBy(id_col).orderBy(*order)
    running = F.col(base) + F.sum(contribution).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return contrib.select(id_col, F.row_number().over(w).alias("step"), feature, contribution,
                          running.alias("logodds"), sigmoid(running).alias("probability"))


def _path_with_base(contrib, id_col, feature, base, contribution):
    order = [F.abs(F.col(contribution)), F.col(feature)]
    w = Window.partitionBy(id_col).orderBy(*order)
    running = F.col(base) + F.sum(contribution).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return contrib.select(id_col, F.row_number().over(w).alias("step"), feature, contribution,
                          running.alias("logodds"), sigmoid(running).alias("probability"),
                          F.col(base).alias("_base"))


_FIELD = re.compile(r"\{(\w+)\}")


def fill(template: str, **fields: Column) -> Column:
    """A ``str.format``-style template filled with column values, as one ``concat``."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(fields[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def attribution_text(contrib: DataFrame, id_col: str = "id", feature: str = "feature",
                     base: str = "base", contribution: str = "contribution",
                     text_base: str = K.TEXT_BASE, text_step: str = K.TEXT_STEP,
                     text_final: str = K.TEXT_FINAL, up: str = K.TEXT_UP,
                     down: str = K.TEXT_DOWN) -> DataFrame:
    """One explanation paragraph per id.

    A contribution counts as an increase only when strictly positive (zero reads as a
    decrease); amounts are absolute values with two decimals, probabilities percentages
    with two decimals.
    """
    path = _path_with_base(contrib, id_col, feature, base, contribution)
    step = fill(text_step, feature=F.col(feature),
                direction=F.when(F.col(contribution) > 0, F.lit(up)).otherwise(F.lit(down)),
                amount=format_fixed(F.abs(F.col(contribution))),
                prob=format_percent(F.col("probability")))
    steps = path.select(id_col, F.struct("step", step.alias("s")).alias("_st"), "logodds", "step", "_base")
    # the window above already clustered rows by id, so this aggregate adds no shuffle
    per_id = steps.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_st")), lambda x: x["s"]), " ").alias("_steps"),
        F.max_by("logodds", "step").alias("_final"), F.max("_base").alias("_base"))
    head = fill(text_base, base=format_fixed(F.col("_base")), prob=format_percent(sigmoid(F.col("_base"))))
    tail = fill(text_final, prob=format_percent(sigmoid(F.col("_final"))))
    return per_id.select(id_col, F.concat_ws(" ", head, "_steps", tail).alias("text"))


def attribution_summary(contrib: DataFrame, feature: str = "feature", value: str = "value",
                        contribution: str = "contribution") -> DataFrame:
    """Global ranking: mean |contribution| and the correlation of a feature's value with
    its contribution (the colour in a summary plot), largest first (M15)."""
    return (contrib.groupBy(feature)
                   .agg(F.avg(F.abs(F.col(contribution))).alias("mean_abs"),
                        F.corr(F.col(value), F.col(contribution)).alias("value_corr"),
                        F.count(F.lit(1)).alias("n"))
                   .orderBy(F.desc("mean_abs"), F.asc(feature)))
