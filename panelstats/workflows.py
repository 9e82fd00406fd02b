"""The source's analyses on its own table layout, composed from the operators.

Defaults are the source's column names (``constants``): an assessment table with
``Ponto, PontoID, Data, Campo, Equipe, Especie01, Avaliador`` and score columns, and a
class table with ``PontoID, Ponto, CLASS_DED, LAT, LON``.  Each function is a plain
composition of the operators in :mod:`panelstats.operators`; every name is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panelstats import constants as K
from panelstats.functions.labels import binary_label, ordinal_label
from panelstats.operators import agreement, attribution, boosting, distribution, model, sampling, thematic, treeshap
from panelstats.operators.columns import score_columns
from panelstats.operators.joins import fan_out_join, join_label, join_on, join_with_suffixes
from panelstats.operators.missing import drop_any_null
from panelstats.operators.profile import distinct_rows, mode_fill, profile
from panelstats.session import written
from panelstats.sources.scan import rows_table, typed_scores

KEY, NAME, DATE, CLASS, SPECIES, HEIGHT = "PontoID", "Ponto", "Data", "CLASS_DED", "Especie01", "Altura"


def prepare_scores(raw: DataFrame, id_columns: Sequence[str] = K.ID_COLUMNS) -> DataFrame:
    """Repair date-damaged score cells and type every score column as double."""
    return typed_scores(raw, score_columns(raw, id_columns), repair_dates=True)


def point_features(assessments: DataFrame, stats: Sequence[str] = ("mean",),
                   id_columns: Sequence[str] = K.ID_COLUMNS, key: str = KEY) -> DataFrame:
    """One row per point with ``<score>_<stat>`` columns."""
    return profile(assessments, [key], score_columns(assessments, id_columns), stats)


def labelled_points(features: DataFrame, classes: DataFrame, key: str = KEY, cls: str = CLASS,
                    negatives: Sequence[str] = K.NEGATIVE_CLASSES, order: Sequence[str] = K.CLASS_ORDER,
                    whole_class_table: bool = False) -> DataFrame:
    """Features joined with the class (or the whole class table), plus the binary label
    ``label`` and the severity ordinal ``ordinal``."""
    x = (join_on(features, classes, [key], "inner") if whole_class_table
         else join_label(features, classes, [key], [cls]))
    return x.withColumns({"label": binary_label(cls, negatives).cast("double"),
                          "ordinal": ordinal_label(cls, order).cast("double")})


def model_features(points: DataFrame, stat: str = "mean",
                   exclude_patterns: Sequence[str] = K.LEAKY_SCORE_PATTERNS) -> list[str]:
    """``<score>_<stat>`` columns, minus those naming a score that leaks the label."""
    suffix = f"_{stat}"
    return [c for c in points.columns
            if c.endswith(suffix) and not any(p in c for p in exclude_patterns)]


def split(points: DataFrame, label: str = "label", key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """The source's stratified 70/30 hold-out (seed 667), written once and read by both parts."""
    s = written(sampling.stratified_split(points, key, label, K.TEST_SHARE, K.SPLIT_SEED), "split")
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def train_binary(train: DataFrame, features: Sequence[str], key: str = KEY, n_candidates: int = K.SEARCH_CANDIDATES,
                 max_iter: int = K.BOOSTED_TREES, folds: int = K.N_FOLDS) -> tuple[boosting.BoostedModel, DataFrame]:
    """Cross-validated search for the binary booster (F1 of the positive class): the best
    candidate fitted on all of ``train``, and the table of candidates.

    The source keeps incomplete rows because missing scores may predict; every split of the
    booster learns the side they go to.
    """
    f = written(sampling.stratified_folds(train, key, "label", folds, K.SPLIT_SEED), "folds")
    draws = model.sample_space(K.SEARCH_SPACE, n_candidates, K.SEARCH_SEED)
    best, table, _ = boosting.search(f, features, "label", "fold", folds, draws, max_iter, K.SEARCH_SEED)
    return boosting.fit(f, features, "label", best), table


def train_multiclass(training: DataFrame, features: Sequence[str] = tuple(K.MULTICLASS_FEATURES), label: str = "factor",
                     n_classes: int = len(K.CLASS_ORDER), params: boosting.Params | None = None) -> boosting.BoostedModel:
    """The five-class booster on its training table, at the source's only grid point."""
    params = params or boosting.Params.of(boosting.parameter_grid(K.MULTICLASS_GRID)[0], seed=K.SEARCH_SEED)
    return boosting.fit(training, list(features), label, params, n_classes)


def train_tree(train: DataFrame, features: Sequence[str]) -> PipelineModel:
    """The depth-4 five-class decision tree (seed 700)."""
    return model.fit_tree(train, features, "ordinal", K.TREE_DEPTH, K.TREE_SEED)


def form_rows(spark: SparkSession, values: Sequence[dict], features: Sequence[str], key: str = KEY) -> DataFrame:
    """What a user entered, one dict per row, as a table of the model's features (S5); scores that
    are not given are missing.  Rows are numbered by ``key``."""
    rows = [(i, *[None if v.get(f) is None else float(v[f]) for f in features]) for i, v in enumerate(values)]
    return rows_table(spark, rows, StructType([StructField(key, LongType())] + [StructField(f, DoubleType()) for f in features]))


def _score(fitted, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return (boosting if isinstance(fitted, boosting.BoostedModel) else model).score(fitted, rows, keep)


def explain(fitted, rows: DataFrame, features: Sequence[str], key: str = KEY) -> DataFrame:
    """Per-row prediction, probability and the explanation paragraph."""
    contrib = treeshap.attribute(fitted, rows, key, features)
    text = attribution.attribution_text(contrib, id_col=key)
    return _score(fitted, rows, [key]).join(text, key)


def thematic_map(fitted, points: DataFrame, classes: DataFrame, key: str = KEY) -> DataFrame:
    """Every point with its position, predicted class text, colour and the map centre."""
    return thematic.thematic_table(_score(fitted, points, [key]), classes, key, lat="LAT", lon="LON",
                                   name=NAME if NAME in classes.columns else None)


def rater_ranges(points_with_ranges: DataFrame, guard: str = "DispFolhVerd_max_min_diff",
                 max_value: float = 6, ids: Sequence[str] = (NAME, "y_pred_class", CLASS), key: str = KEY) -> DataFrame:
    """Box statistics of every score's rater range (max - min), after the range guard."""
    ranges = [c for c in points_with_ranges.columns if c.endswith("_max_min_diff")]
    long = distribution.guarded_melt(points_with_ranges, [key, *[i for i in ids if i in points_with_ranges.columns]],
                                     ranges, guard, max_value)
    return distribution.box_stats(long, ["variable"], "value")


def _species_fan_out(profiles: DataFrame, assessments: DataFrame, key: str, name: str, species: str) -> DataFrame:
    """Left join of the distinct (key, name, species): a point with two species has two rows."""
    return join_on(profiles, distinct_rows(assessments, [key, name, species]), [key, name], "left")


def rater_sd_over_time(assessments: DataFrame, seq: str, score_cols: Sequence[str] | None = None,
                       id_columns: Sequence[str] = K.ID_COLUMNS, key: str = KEY, name: str = NAME, date: str = DATE,
                       species: str | None = SPECIES, height: str = HEIGHT, date_col: str = DATE) -> DataFrame:
    """Sample sd of every score between raters, dated by the first visit, newest first.

    Rows with a missing cell are dropped first.  Per (key, name) the sd of every score, the
    left join of the species (which fans out), the key dropped, the date of the name's first
    row joined, then one row per score.  The height is text in the source and has no series.
    """
    a = drop_any_null(assessments)
    cols = list(score_cols or [c for c in score_columns(a, id_columns) if c != height])
    sd = profile(a, [key, name], cols, ["media", "sd"], drop_null_keys=False)
    if species:
        sd = _species_fan_out(sd, a, key, name, species)
    visits = agreement.first_visit(a, name, date, seq, date_col=date_col)
    return agreement.disagreement_over_time(sd.drop(key), visits, name, [f"{c}_sd" for c in cols], date_col=date_col)


def training_table(assessments: DataFrame, classes: DataFrame, seq: str, score_cols: Sequence[str] | None = None,
                   id_columns: Sequence[str] = K.ID_COLUMNS, key: str = KEY, name: str = NAME, date: str = DATE,
                   species: str = SPECIES, height: str = HEIGHT, cls: str = CLASS, date_col: str = DATE,
                   folds: int = K.N_FOLDS, seed: int = K.SPLIT_SEED) -> DataFrame:
    """The five-class booster's training table with its folds.

    Heights replaced by the mode of their point; mean and sd of every score per (key, name);
    the heights joined back, the species left-joined (fans out), the key dropped; the date
    of the name's first row; the classes joined on the name alone (fans out); rows with a
    missing cell dropped; the class as a factor (numbered by name) and the height as a
    number; a stratified fold per row.  ``row_key`` tells the fanned-out rows apart.
    """
    filled = mode_fill(assessments, [key, name], height, seq)
    cols = list(score_cols or [c for c in score_columns(assessments, id_columns) if c != height])
    stats = profile(filled, [key, name], cols, ["media", "sd"], drop_null_keys=False)
    # the narrow tables meet first, so the statistics are not shuffled again for each of them
    x = join_on(distinct_rows(filled, [name, height, key]), agreement.first_visit(assessments, name, date, seq, date_col=date_col),
                [name], "inner")
    x = join_on(_species_fan_out(x, assessments, key, name, species), stats, [name, key], "inner")
    x = x.select(name, F.col(key).alias("_left_key"), *[c for c in stats.columns if c not in (key, name)], height, species, date_col)
    x = fan_out_join(written(x, "profiles"), written(distinct_rows(classes, [name, cls, key]), "classes"), [name])
    row_key = F.concat_ws(":", F.col("_left_key").cast("string"), F.coalesce(F.col(species), F.lit("")), F.col(key).cast("string"))
    x = drop_any_null(x, [c for c in x.columns if c != "_left_key"])
    x = x.withColumn(height, F.col(height).try_cast("double"))
    x = written(x, "training")
    order = x.select(cls).distinct().agg(F.sort_array(F.collect_list(cls)).alias("c")).first()["c"]  # the class names
    x = sampling.stratified_folds(x, row_key, cls, folds, seed)
    return x.select(*[c for c in x.columns if c not in ("_left_key", "fold")], row_key.alias("row_key"),
                    ordinal_label(cls, order).alias("factor"), "fold")


def full_join_for_map(assessments: DataFrame, classes: DataFrame, key: str = KEY) -> DataFrame:
    """Every rater row with its class row; clashing names get ``_left``/``_right``."""
    return join_with_suffixes(assessments, classes, [key], "left")
