"""One Spark query per operator key, over the driver's tables (see ``fixtures``).

Every query reads whole tables; float outputs are rounded to ``fixtures.DIGITS``
decimals so engines that add in another order agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats import constants as K
from panelstats.functions.labels import binary_label, ordinal_label
from panelstats.functions.repair import repair_date_score, was_date_repaired
from panelstats.functions.scalar import sigmoid
from panelstats.operators import agreement, attribution, distribution, metrics, missing, sampling
from panelstats.operators.columns import columns_at, drop_matching, select_scores, stat_columns
from panelstats.operators.joins import fan_out_join, join_label, join_on, join_with_suffixes
from panelstats.operators.profile import (class_distribution, distinct_rows, feature_ranges,
                                          first_row, mode_fill, mode_first_seen, profile)
from panelstats.plans import fixtures as fx
from panelstats.plans.fixtures import SCORES, round_doubles
from panelstats.session import shared_path, written
from panelstats.sources.sheets import read_sheets, write_sheets
from panelstats.sources.scan import column_profile, read_table, typed_scores, write_table
from panelstats.workflows import rater_sd_over_time, training_table

Query = Callable[[SparkSession, str], DataFrame]
MEANS = [f"{s}_mean" for s in SCORES]
RANGES = [f"{s}_max_min_diff" for s in SCORES]


# ---------------------------------------------------------------- shared building blocks
def _profile(spark, sf, stats=("mean",), keys=("point_id",), src=None) -> DataFrame:
    return round_doubles(profile(fx.assessments(spark, sf) if src is None else src, list(keys), SCORES, stats))


def _scored_classes(spark, sf) -> DataFrame:
    """Per-point mean/min/max/range joined with the class table, plus the binary label: the
    serving table of the descriptive and model views, at full precision, as Parquet in the
    shared folder, so each view prunes its columns and pushes its filters into the scan."""
    prof = profile(fx.assessments(spark, sf), ["point_id"], SCORES, ("mean", "min", "max", "max_min_diff"))
    x = join_label(prof, fx.classes(spark, sf), ["point_id"], ["class"])
    return written(x.withColumn("label", binary_label("class", fx.PRIORITY_NEGATIVE)), "serving")


def _typed_lineitem(spark, sf) -> DataFrame:
    li = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", *SCORES)
    return typed_scores(li, SCORES)


def _events(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _event_profile(spark, sf):
    ev = _events(spark, sf)
    prof = profile(ev, ["user_id", "event_type"], ["value"], ["media", "sd"])
    visits = agreement.first_visit(ev, "user_id", "ts", "event_id")
    return prof, visits


# ---------------------------------------------------------------- scans, projections
def scan_typed(spark, sf):
    return _typed_lineitem(spark, sf)


def profile_columns(spark, sf):
    return column_profile(fx.table(spark, sf, "lineitem"))


def select_scores_q(spark, sf):
    return select_scores(fx.table(spark, sf, "lineitem"), exclude=fx.LINEITEM_NON_SCORES)


def drop_by_pattern(spark, sf):
    return drop_matching(_profile(spark, sf, ("mean", "min", "max", "max_min_diff")),
                         ["min", "max", "l_tax"])


def keep_stat_columns(spark, sf):
    """The mean of every score but those of a name pattern (P3), from the wide profile."""
    p = _profile(spark, sf, ("mean", "min", "max", "max_min_diff"))
    return p.select("point_id", *stat_columns(SCORES, "mean", ["tax"]))


def select_positions(spark, sf):
    """Columns by their place, counted from 1 (P5): the name and the date of every row."""
    li = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_shipdate", "l_linenumber")
    return li.select(*columns_at(li, [1, 3]))


def class_table_csv(spark, sf):
    """The class and position table as a CSV export read with its schema."""
    path = write_table(fx.classes(spark, sf), shared_path(spark, "tables", "classes_csv"), fmt="csv", header=True)
    return round_doubles(read_table(spark, path, "point_id long, class string, status string, lat double, lon double", fmt="csv"))


def head_n(spark, sf):
    return _profile(spark, sf).orderBy("point_id").limit(10)


def scan_csv(spark, sf):
    """A sheet export as text: scores written to CSV with the cells a spreadsheet damages, read
    back with a text schema, repaired and typed."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[
        _damaged(c).alias(c) if c == "l_quantity" else F.col(c).cast("string").alias(c) for c in SCORES])
    path = write_table(li, shared_path(spark, "tables", "export_csv"), fmt="csv", header=True)
    schema = "l_orderkey long, l_linenumber int, " + ", ".join(f"{c} string" for c in SCORES)
    return typed_scores(read_table(spark, path, schema, fmt="csv"), SCORES, repair_dates=True)


def scan_sheets(spark, sf):
    """The same through spreadsheet files: written as workbooks, read back as text cells, repaired."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[
        _damaged(c).alias(c) if c == "l_quantity" else F.col(c) for c in SCORES])
    back = read_sheets(spark, write_sheets(li, shared_path(spark, "tables", "sheets")))
    typed = typed_scores(back, SCORES, repair_dates=True)
    return typed.withColumns({"l_orderkey": F.col("l_orderkey").cast("long"), "l_linenumber": F.col("l_linenumber").cast("int")})


def write_roundtrip(spark, sf):
    path = write_table(_typed_lineitem(spark, sf), shared_path(spark, "tables", "typed_lineitem"))
    return read_table(spark, path)


# ---------------------------------------------------------------- repair and missing values
# cells that a cast alone would read as a number or a date, by the row they are put into
ODD_CELLS = ["12:30", "2024-3", "7d", "5f", "0x1p3", "Infinity", "2024-02-30", "2024-13-01", " 5.3 ", "1e1", "-.5", "5.", ""]


def _damaged(col: str):
    """Scores as the damaged export has them: dates in the rows of flag R, odd cells in every
    eleventh row of line 3."""
    odd = F.element_at(F.array(*[F.lit(x) for x in ODD_CELLS]), (F.pmod(F.col("l_orderkey"), F.lit(len(ODD_CELLS))) + 1).cast("int"))
    return F.when((F.col("l_linenumber") == 3) & (F.pmod(F.col("l_orderkey"), F.lit(11)) == 0), odd).when(
        F.col("l_returnflag") == "R", F.col("l_shipdate").cast("string")).otherwise(F.col(col).cast("string"))


def repair_date_scores(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    r = li.select("l_orderkey", "l_linenumber", _damaged("l_quantity").alias("raw"))
    return r.select("*", repair_date_score("raw").alias("score"),
                    was_date_repaired("raw").alias("was_repaired"))


def rows_any_null(spark, sf):
    return missing.rows_any_null(fx.with_nulls(spark, sf))


def drop_any_null(spark, sf):
    return missing.drop_any_null(fx.with_nulls(spark, sf))


def null_cell_counts(spark, sf):
    return missing.null_cell_counts(fx.with_nulls(spark, sf))


def range_guard(spark, sf):
    return missing.range_guard(fx.with_nulls(spark, sf), "l_discount", 0.05)


# ---------------------------------------------------------------- profiles
def profile_mean(spark, sf):
    return _profile(spark, sf, ("mean",))


def profile_stats(spark, sf):
    return _profile(spark, sf, ("mean", "min", "max", "max_min_diff"))


def profile_mean_sd(spark, sf):
    return _profile(spark, sf, ("media", "sd"))


def mode_first_seen_q(spark, sf):
    return mode_first_seen(_events(spark, sf), ["user_id"], "event_type", "event_id")


def mode_fill_q(spark, sf):
    return mode_fill(_events(spark, sf).drop("ts"), ["user_id"], "event_type", "event_id")


def mode_fill_signed_zero(spark, sf):
    """A floating-point key with 0.0, -0.0 and NULL: one group, one group and a group."""
    li = fx.table(spark, sf, "lineitem")
    key = F.when(F.col("l_linenumber") == 1, F.lit(0.0)).when(F.col("l_linenumber") == 2, F.lit(-0.0)).when(
        F.col("l_linenumber") != 3, F.col("l_discount"))
    rows = li.select(F.expr(fx.ROW_ORDER).alias("seq"), key.alias("k"), "l_returnflag")
    filled = mode_fill(rows, ["k"], "l_returnflag", "seq")
    return filled.select("seq", (F.col("k") + F.lit(0.0)).alias("k"), "l_returnflag")


def first_row_per_key(spark, sf):
    return first_row(_events(spark, sf), ["user_id"], "event_id")


def distinct_attrs(spark, sf):
    return distinct_rows(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"])


# ---------------------------------------------------------------- labels
def _orders(spark, sf):
    return fx.table(spark, sf, "orders")


def class_distribution_q(spark, sf):
    return class_distribution(_orders(spark, sf), "o_orderpriority")


def class_order(spark, sf):
    d = class_distribution(_orders(spark, sf), "o_orderpriority")
    return (d.select("o_orderpriority", ordinal_label("o_orderpriority", fx.PRIORITY_ORDER).alias("ordinal"), "n")
             .orderBy("ordinal"))


def label_ordinal(spark, sf):
    o = _orders(spark, sf)
    return o.select("o_orderkey", "o_orderpriority",
                    ordinal_label("o_orderpriority", fx.PRIORITY_ORDER).alias("label"))


def label_binary(spark, sf):
    o = _orders(spark, sf).select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("class"))
    return o.select("o_orderkey", "class", binary_label("class", fx.PRIORITY_NEGATIVE).alias("label"))


def label_index(spark, sf):
    o = _orders(spark, sf).select("o_orderkey", "o_orderpriority")
    model = StringIndexer(inputCol="o_orderpriority", outputCol="label_index",
                          stringOrderType="alphabetAsc").fit(o)
    return model.transform(o)


# ---------------------------------------------------------------- joins
def join_label_inner(spark, sf):
    return join_label(_profile(spark, sf), fx.classes(spark, sf), ["point_id"], ["class"])


def join_geo_inner(spark, sf):
    return join_on(_profile(spark, sf, ("mean", "min", "max", "max_min_diff")),
                   fx.classes(spark, sf), ["point_id"], "inner")


def join_left_suffix(spark, sf):
    """The class table lacks one class, so its points stay without a partner."""
    some = fx.classes(spark, sf).where(F.col("class") != "5-LOW")
    return join_with_suffixes(fx.assessments(spark, sf), some, ["point_id"], "left")


def _two_key(spark, sf):
    prof = _profile(spark, sf, ("media", "sd"), keys=("point_id", "point"))
    attrs = distinct_rows(fx.assessments(spark, sf), ["point_id", "point", "status"])
    return prof, attrs


def join_two_keys(spark, sf):
    prof, attrs = _two_key(spark, sf)
    return join_on(prof, attrs, ["point_id", "point"], "inner")


def join_left_two_keys(spark, sf):
    """The attributes of one point name are missing, so its profiles stay without a partner."""
    prof, attrs = _two_key(spark, sf)
    return join_on(prof, attrs.where(F.col("point") != "N"), ["point_id", "point"], "left")


def join_fanout(spark, sf):
    """Joined on the name alone, which several ids share on both sides."""
    prof = _profile(spark, sf, keys=("point_id", "point"), src=fx.named_assessments(spark, sf)).drop("point_id")
    ids = distinct_rows(fx.named_classes(spark, sf), ["point", "point_id", "class"])
    return fan_out_join(written(prof, "profile"), written(ids, "ids"), ["point"])


def join_first_visit(spark, sf):
    prof, visits = _event_profile(spark, sf)
    return round_doubles(join_on(prof, visits, ["user_id"], "inner"))


def disagreement_over_time(spark, sf):
    prof, visits = _event_profile(spark, sf)
    return round_doubles(agreement.disagreement_over_time(
        prof, visits, "user_id", sd_cols=["value_sd"], long_by="event_type"))


def disagreement_unpivoted(spark, sf):
    """The whole series: complete rows, sd of every score per point, species fan-out, date of
    the first visit, unpivoted."""
    a = fx.named_assessments(spark, sf)
    return round_doubles(rater_sd_over_time(a, "seq", SCORES, key="point_id", name="point", date="visit_ts",
                                            species="species", date_col="visit_date"))


def training_table_q(spark, sf):
    """The five-class booster's training table, composed as one job."""
    return round_doubles(training_table(
        fx.named_assessments(spark, sf), fx.named_classes(spark, sf), "seq", SCORES, key="point_id", name="point",
        date="visit_ts", species="species", height="height", cls="class", date_col="visit_date"))


# ---------------------------------------------------------------- distributions
def feature_ranges_q(spark, sf):
    return round_doubles(feature_ranges(_profile(spark, sf), MEANS))


def score_correlation(spark, sf):
    return round_doubles(distribution.correlation_matrix(fx.table(spark, sf, "lineitem"), SCORES))


def scatter_bins(spark, sf):
    x = join_label(_profile(spark, sf), fx.classes(spark, sf), ["point_id"], ["class"])
    return round_doubles(distribution.scatter_bins(x, "l_quantity_mean", "l_tax_mean", "class", 5.0, 0.01))


def _melted(spark, sf):
    x = _scored_classes(spark, sf)
    return distribution.guarded_melt(x, ["point_id", "class"], RANGES, "l_quantity_max_min_diff", 40.0)


def melt_ranges(spark, sf):
    return round_doubles(_melted(spark, sf))


def box_by_variable(spark, sf):
    return round_doubles(distribution.box_stats(_melted(spark, sf), ["variable"], "value"), fx.BOX_DIGITS)


def box_by_class(spark, sf):
    return round_doubles(distribution.box_stats(_scored_classes(spark, sf), ["class", "label"],
                                                "l_quantity_mean"), fx.BOX_DIGITS)


def box_outliers(spark, sf):
    return round_doubles(distribution.box_outliers(_scored_classes(spark, sf), ["class"],
                                                   "l_extendedprice_mean", keep=["point_id"]), fx.BOX_DIGITS)


# ---------------------------------------------------------------- sampling
def _priorities(spark, sf):
    return _orders(spark, sf).select("o_orderkey", "o_orderpriority")


def stratified_split(spark, sf):
    return sampling.stratified_split(_priorities(spark, sf), "o_orderkey", "o_orderpriority", K.TEST_SHARE, K.SPLIT_SEED)


def stratified_folds(spark, sf):
    return sampling.stratified_folds(_priorities(spark, sf), "o_orderkey", "o_orderpriority", K.N_FOLDS, K.SPLIT_SEED)


def split_sizes(spark, sf):
    return sampling.split_sizes(stratified_split(spark, sf))


def fold_rows(spark, sf):
    return sampling.fold_rows(stratified_folds(spark, sf), 0, held_out=False)


# ---------------------------------------------------------------- metrics
def classification_report(spark, sf):
    return round_doubles(metrics.classification_report(fx.table(spark, sf, "labels"), "quality", "toxic"))


def confusion_matrix(spark, sf):
    return round_doubles(metrics.confusion_matrix(fx.table(spark, sf, "labels"), "quality", "toxic", [0, 1]))


# ---------------------------------------------------------------- attribution over given contributions
def contributions(spark, sf) -> DataFrame:
    """Contributions made from the lineitem means: ``tanh`` of each standardised mean, and
    the log-odds of the positive share of the class table as the base."""
    p = _profile(spark, sf)
    st = p.agg(*[F.avg(m).alias(f"a{i}") for i, m in enumerate(MEANS)],
               *[F.stddev_pop(m).alias(f"s{i}") for i, m in enumerate(MEANS)]).first()
    share = fx.classes(spark, sf).agg(F.avg(binary_label("class", fx.PRIORITY_NEGATIVE))).first()[0]
    base = math.log(share / (1.0 - share))
    cells = [F.struct(F.lit(m).alias("feature"), F.col(m).alias("value"),
                      F.tanh((F.col(m) - F.lit(st[f"a{i}"])) / F.lit(st[f"s{i}"])).alias("contribution"))
             for i, m in enumerate(MEANS)]
    return (p.select(F.col("point_id").alias("id"), F.explode(F.array(*cells)).alias("c"))
             .select("id", "c.*", F.lit(base).alias("base")))


def sigmoid_q(spark, sf):
    c = contributions(spark, sf)
    return round_doubles(c.select("id", "feature", "contribution", sigmoid("contribution").alias("probability")))


def attribution_total(spark, sf):
    return round_doubles(attribution.attribution_total(contributions(spark, sf)))


def attribution_path(spark, sf):
    return round_doubles(attribution.attribution_path(contributions(spark, sf)))


def attribution_text(spark, sf):
    return attribution.attribution_text(contributions(spark, sf))


def attribution_summary(spark, sf):
    return round_doubles(attribution.attribution_summary(contributions(spark, sf)))


SQL_CHECKED: dict[str, Query] = {
    "scan_typed": scan_typed,
    "scan_csv": scan_csv,
    "scan_sheets": scan_sheets,
    "profile_columns": profile_columns,
    "select_scores": select_scores_q,
    "drop_by_pattern": drop_by_pattern,
    "keep_stat_columns": keep_stat_columns,
    "select_positions": select_positions,
    "class_table_csv": class_table_csv,
    "head_n": head_n,
    "write_roundtrip": write_roundtrip,
    "repair_date_scores": repair_date_scores,
    "rows_any_null": rows_any_null,
    "drop_any_null": drop_any_null,
    "null_cell_counts": null_cell_counts,
    "range_guard": range_guard,
    "profile_mean": profile_mean,
    "profile_stats": profile_stats,
    "profile_mean_sd": profile_mean_sd,
    "mode_first_seen": mode_first_seen_q,
    "mode_fill": mode_fill_q,
    "mode_fill_signed_zero": mode_fill_signed_zero,
    "first_row_per_key": first_row_per_key,
    "class_distribution": class_distribution_q,
    "class_order": class_order,
    "label_ordinal": label_ordinal,
    "label_binary": label_binary,
    "label_index": label_index,
    "distinct_attrs": distinct_attrs,
    "join_label_inner": join_label_inner,
    "join_geo_inner": join_geo_inner,
    "join_left_suffix": join_left_suffix,
    "join_two_keys": join_two_keys,
    "join_left_two_keys": join_left_two_keys,
    "join_fanout": join_fanout,
    "join_first_visit": join_first_visit,
    "disagreement_over_time": disagreement_over_time,
    "disagreement_unpivoted": disagreement_unpivoted,
    "training_table": training_table_q,
    "feature_ranges": feature_ranges_q,
    "score_correlation": score_correlation,
    "scatter_bins": scatter_bins,
    "melt_ranges": melt_ranges,
    "box_by_variable": box_by_variable,
    "box_by_class": box_by_class,
    "box_outliers": box_outliers,
    "stratified_split": stratified_split,
    "stratified_folds": stratified_folds,
    "fold_rows": fold_rows,
    "split_sizes": split_sizes,
    "classification_report": classification_report,
    "confusion_matrix": confusion_matrix,
    "sigmoid": sigmoid_q,
    "attribution_total": attribution_total,
    "attribution_path": attribution_path,
    "attribution_text": attribution_text,
    "attribution_summary": attribution_summary,
}
