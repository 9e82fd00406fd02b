"""Tree classifiers with ``spark.ml``.

Every model is a ``PipelineModel``: mean imputation (boosted trees in the source accept
missing scores; Spark trees do not) -> ``VectorAssembler`` -> classifier, so feature names
and imputation travel with the saved model.  Training, scoring and evaluation are
distributed Spark jobs; only parameters and per-candidate metrics live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats import constants as K

FEATURES = "features"


def prepared(name: str) -> str:
    """Column holding the imputed copy of feature ``name``."""
    return f"{name}__in"


def preparation(features: Sequence[str], missing_indicators: bool = False) -> list:
    """Imputer (mean) and assembler stages shared by every model (M3).

    Spark trees cannot learn a direction for missing values as the source's booster
    does; with ``missing_indicators`` a 0/1 ``<feature>_missing`` column per feature is
    added next to the imputed value, so the trees can still split on missingness.
    """
    cols = [prepared(f) for f in features]
    stages = [Imputer(inputCols=list(features), outputCols=cols, strategy="mean")]
    if missing_indicators:
        flags = ", ".join(f"CAST(`{f}` IS NULL OR isnan(`{f}`) AS DOUBLE) AS `{f}_missing`" for f in features)
        stages.append(SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"))
        cols = cols + [f"{f}_missing" for f in features]
    return stages + [VectorAssembler(inputCols=cols, outputCol=FEATURES)]


def tree_classifier(label: str, max_depth: int = 4, seed: int = 700, impurity: str = "gini"):
    return DecisionTreeClassifier(labelCol=label, featuresCol=FEATURES, maxDepth=max_depth,
                                  seed=seed, impurity=impurity)


def boosted_classifier(label: str, **params):
    """``GBTClassifier``; ``params`` use Spark names (maxIter, maxDepth, stepSize, ...)."""
    return GBTClassifier(labelCol=label, featuresCol=FEATURES, **params)


def fit_tree(train: DataFrame, features: Sequence[str], label: str, max_depth: int = 4,
             seed: int = 700, missing_indicators: bool = False) -> PipelineModel:
    """Decision tree, any number of classes (M4)."""
    return Pipeline(stages=preparation(features, missing_indicators) + [tree_classifier(label, max_depth, seed)]).fit(train)


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, missing_indicators: bool = False,
                **params) -> PipelineModel:
    """Boosted trees, binary label 0/1 (M5); 500 trees unless ``maxIter`` says otherwise."""
    params.setdefault("maxIter", K.BOOSTED_TREES)
    return Pipeline(stages=preparation(features, missing_indicators) + [boosted_classifier(label, **params)]).fit(train)


def fit_boosted_multiclass(train: DataFrame, features: Sequence[str], label: str, parallelism: int = 1,
                           missing_indicators: bool = False, **params) -> PipelineModel:
    """Boosted trees for k classes: one binary booster per class (M6).  Without ``params`` the
    source's grid point is used."""
    params = params or parameter_grid(K.MULTICLASS_GRID)[0]
    ovr = OneVsRest(classifier=GBTClassifier(featuresCol=FEATURES, **params), labelCol=label,
                    featuresCol=FEATURES, parallelism=parallelism)
    return Pipeline(stages=preparation(features, missing_indicators) + [ovr]).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], positive_probability: bool = True) -> DataFrame:
    """Score a whole table: kept columns, ``prediction`` (int) and, for probabilistic binary
    models, ``probability`` of class 1 (M12, M13)."""
    out = model.transform(df)
    cols = [*keep, F.col("prediction").cast("int").alias("prediction")]
    if positive_probability and "probability" in out.columns:
        cols.append(vector_to_array("probability")[1].alias("probability"))
    return out.select(*cols)


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def accuracy(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: ``n`` scored rows and the share predicted right."""
    return scored.agg(F.count(F.lit(1)).alias("n_test"),
                      F.avg((F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double"))
                      .alias("accuracy"))


# ------------------------------------------------------------------ parameter search
# The source's search space, in its own names; the L1/L2 terms have no Spark counterpart and
# are left out.  Spark's trees allow a depth of 30 and a step of 1.0 at most.
REFERENCE_SPACE = K.SEARCH_SPACE
SPARK_LIMITS = {"max_depth": (1, 30), "learning_rate": (1e-6, 1.0), "colsample_bytree": (0.01, 1.0)}


def clamped_space(space: Mapping[str, tuple]) -> dict:
    """The part of a space that Spark can train, so that draws spread over it evenly instead of
    piling up on its edge."""
    out = {}
    for name, (kind, lo, hi) in space.items():
        low, high = SPARK_LIMITS.get(name, (lo, hi))
        out[name] = (kind, min(max(lo, low), high), max(min(hi, high), low))
    return out


def parameter_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every point of a grid of source-named parameters, as Spark parameters."""
    points = [{}]
    for name, values in grid.items():
        points = [{**p, name: v} for p in points for v in values]
    return [spark_params(p) for p in points]


def sample_space(space: Mapping[str, tuple], n: int, seed: int) -> list[dict]:
    """``n`` seeded random draws from the space (the source's Bayesian search is not rebuilt)."""
    rng = np.random.RandomState(seed)
    draws = []
    for _ in range(n):
        d = {}
        for name, (kind, lo, hi) in space.items():
            if kind == "int":
                d[name] = int(rng.randint(lo, hi + 1))
            elif kind == "uniform":
                d[name] = float(rng.uniform(lo, hi))
            else:
                d[name] = float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
        draws.append(d)
    return draws


def spark_params(draw: Mapping[str, float]) -> dict:
    """Map source-named values to GBT parameters (values are within Spark's ranges)."""
    out = {}
    if "nrounds" in draw:
        out["maxIter"] = int(draw["nrounds"])
    if "max_depth" in draw:
        out["maxDepth"] = int(draw["max_depth"])
    if "learning_rate" in draw or "eta" in draw:
        out["stepSize"] = float(draw.get("learning_rate", draw.get("eta")))
    if "colsample_bytree" in draw:
        out["featureSubsetStrategy"] = f"{draw['colsample_bytree']:.4f}"
    if "subsample" in draw:
        out["subsamplingRate"] = float(draw["subsample"])
    if "min_child_weight" in draw:
        out["minInstancesPerNode"] = int(max(1, draw["min_child_weight"]))
    if "gamma" in draw:
        out["minInfoGain"] = float(draw["gamma"])
    return out


def tune_boosted(train: DataFrame, features: Sequence[str], label: str, fold_col: str, k: int,
                 space: Mapping[str, tuple] = REFERENCE_SPACE, n_candidates: int = K.SEARCH_CANDIDATES,
                 seed: int = K.SEARCH_SEED, max_iter: int = K.BOOSTED_TREES, parallelism: int = 1,
                 positive: float = 1.0, missing_indicators: bool = False):
    """Cross-validated random search maximising F1 of the positive class (M7, M8).

    ``scale_pos_weight`` becomes a per-candidate weight column (positive rows weigh w).
    Returns ``(best PipelineModel, candidates DataFrame)``; the candidates table has the
    drawn values, the Spark parameters and the mean F1 over the folds.
    """
    spark = train.sparkSession
    draws = sample_space(clamped_space(space), n_candidates, seed)
    data = train
    gbt = boosted_classifier(label, maxIter=max_iter, seed=seed)
    maps = []
    for i, d in enumerate(draws):
        pm = {getattr(gbt, k2): v for k2, v in spark_params(d).items()}
        if "scale_pos_weight" in d:
            wcol = f"_w{i}"
            data = data.withColumn(wcol, F.when(F.col(label) == positive, F.lit(d["scale_pos_weight"]))
                                   .otherwise(F.lit(1.0)))
            pm[gbt.weightCol] = wcol
        maps.append(pm)
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                                  metricName="fMeasureByLabel", metricLabel=positive)
    cv = CrossValidator(estimator=Pipeline(stages=preparation(features, missing_indicators) + [gbt]), estimatorParamMaps=maps,
                        evaluator=evaluator, foldCol=fold_col, numFolds=k, parallelism=parallelism, seed=seed)
    cv_model = cv.fit(data)
    best = int(np.argmax(cv_model.avgMetrics))
    rows = []
    for i, (d, m) in enumerate(zip(draws, cv_model.avgMetrics)):
        p = spark_params(d)
        rows.append((i, int(p.get("maxDepth", 0)), float(p.get("stepSize", 0.0)),
                     p.get("featureSubsetStrategy", "all"), float(d.get("scale_pos_weight", 1.0)),
                     float(m), i == best))
    table = spark.createDataFrame(rows, "candidate int, max_depth int, step_size double, feature_subset string, "
                                        "pos_weight double, mean_f1 double, is_best boolean")
    return cv_model.bestModel, table


# ------------------------------------------------------------------ fold loop
def cross_validate(folds: DataFrame, features: Sequence[str], label: str, fit, k: int,
                   fold_col: str = "fold", invert: bool = False, parallelism: int = 1) -> DataFrame:
    """Train on all folds but one, score the one left out, one accuracy row per fold.

    ``fit(train_df) -> PipelineModel``.  ``invert=True`` trains on the single fold and
    scores the other k-1, as the source's loop does.  A fold that cannot be fitted (an
    invalid argument or training data that the estimator refuses) yields a row with NULL
    accuracy and the message in ``error``; any other failure, such as a lost job, is raised.
    Folds are independent, so up to ``parallelism`` fits are submitted at once.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = folds.sparkSession

    def one(i: int) -> DataFrame:
        held = F.col(fold_col) == i
        train, test = (folds.where(held), folds.where(~held)) if invert else (folds.where(~held), folds.where(held))
        try:
            fitted = fit(train)
        except (ValueError, IllegalArgumentException) as e:
            return spark.createDataFrame([(i, 0, None, str(e)[:500])], "fold int, n_test long, accuracy double, error string")
        row = accuracy(fitted.transform(test), label)
        return row.select(F.lit(i).alias("fold"), "n_test", "accuracy", F.lit(None).cast("string").alias("error"))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance of each feature in the fitted trees, largest first."""
    stage = model.stages[-1]
    imp = stage.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return (spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
                 .orderBy(F.desc("importance"), F.asc("feature")))
