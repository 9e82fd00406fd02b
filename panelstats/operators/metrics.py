"""Classification metrics from one confusion aggregate.

The scored table is reduced once to ``(label, prediction, n)``, at most classes^2 rows;
everything after that is arithmetic on that tiny table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.session import small_table


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)`` with labels and predictions as text."""
    return (df.select(F.col(label).cast("string").alias("label"),
                      F.col(prediction).cast("string").alias("prediction"))
              .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))


def _div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _row(name, p, r, f):
    return F.struct(F.lit(name).alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1_score"), F.col("total").alias("support"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """scikit-learn's ``classification_report`` as rows (zero division -> 0).

    ``(class, precision, recall, f1_score, support)`` per class, then ``accuracy`` (its
    value in ``f1_score``, precision and recall NULL), ``macro avg`` and ``weighted avg``.
    F1 is ``2 tp / (support + predicted)``, as scikit-learn computes it.  The scored
    input is read once: the confusion table (classes^2 rows) is materialised and all the
    rest is derived from it.
    """
    c, _ = small_table(confusion(df, label, prediction))
    # each confusion cell counts once for its true class and once for its predicted class
    roles = c.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("r")).select("r.*")
    per = roles.groupBy("class").agg(*[F.sum(x).cast("long").alias(x) for x in ("support", "predicted", "tp")])
    per = per.select("class", _div(F.col("tp"), F.col("predicted")).alias("precision"),
                     _div(F.col("tp"), F.col("support")).alias("recall"),
                     _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
                     "support", "tp")
    total = F.sum("support")
    summary = per.agg(
        total.alias("total"), F.sum("tp").alias("correct"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("wf"))
    tail = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 _div(F.col("correct"), F.col("total")).alias("f1_score"), F.col("total").alias("support")),
        _row("macro avg", "mp", "mr", "mf"),
        _row("weighted avg", "wp", "wr", "wf"),
    )).alias("r")).select("r.*")
    return per.select("class", "precision", "recall", "f1_score", "support").unionByName(tail)


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """caret's ``confusionMatrix(prediction, reference)``: one row per predicted class,
    a count column ``ref_<class>`` per reference class, and the overall ``accuracy``."""
    c, _ = small_table(confusion(df, label, prediction))
    names = [str(x) for x in classes]
    wide = (c.groupBy("prediction")
             .pivot("label", names).agg(F.sum("n")))
    wide = wide.select("prediction", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(f"ref_{n}")
                                       for n in names])
    # accuracy over the whole (classes x classes) table: a window on a few rows
    diag = F.lit(0)
    for n in names:
        diag = diag + F.when(F.col("prediction") == n, F.col(f"ref_{n}")).otherwise(0)
    row_total = sum((F.col(f"ref_{n}") for n in names), F.lit(0))
    everything = Window.partitionBy()
    return wide.withColumn("accuracy", _div(F.sum(diag).over(everything), F.sum(row_total).over(everything)))


def mean_over_folds(per_fold: DataFrame, metric: str, out: str = "mean_metric") -> DataFrame:
    """Add the mean of ``metric`` over the folds that have one, and how many those are."""
    every = Window.partitionBy()
    return per_fold.withColumns({out: F.avg(metric).over(every), "folds_scored": F.count(metric).over(every)})
