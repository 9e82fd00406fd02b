"""Model keys: they run on the whole tables and keep their properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from panelstats.plans import modelling as M


@pytest.mark.parametrize("key", ["tree_multiclass", "boosted_binary", "feature_importance", "tree_rules",
                                 "score_rows"])
def test_model_key_runs(spark, key):
    df = E.queries()[key](spark, SMALL)
    assert df.count() > 0


def test_roundtrip_scores_equal(spark):
    a = E.queries()["score_points"](spark, SMALL)
    b = E.queries()["model_roundtrip"](spark, SMALL)
    assert a.count() == b.count() == M._points(spark, SMALL).count()
    assert a.exceptAll(b).count() == 0


def test_thematic_colours(spark):
    t = E.queries()["thematic_points"](spark, SMALL)
    bad = t.where(((F.col("prediction") == 1) & (F.col("prediction_class") != "DEGRADADA")) |
                  ((F.col("prediction") == 0) & (F.col("color")[1] != 255)))
    assert t.count() > 0 and bad.count() == 0


def test_report_shape(spark):
    r = E.queries()["boosted_binary"](spark, SMALL)
    classes = {x["class"] for x in r.collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= classes


def test_fold_loop_inverted_and_failed_fold(spark):
    from panelstats.operators import model as mdl
    from panelstats.operators.sampling import stratified_folds
    pts = M._points(spark, SMALL)
    folds = stratified_folds(pts, "point_id", "ordinal", 3, 1)

    def fit(train):
        if train.where("fold = 1").count() == train.count():   # inverted loop, fold 1 alone: fail it
            raise ValueError("boom")
        return mdl.fit_tree(train, M.TREE_FEATURES, "ordinal", max_depth=2)

    rows = {r["fold"]: r for r in mdl.cross_validate(folds, M.TREE_FEATURES, "ordinal", fit, 3, invert=True,
                                                     parallelism=3).collect()}
    assert rows[1]["accuracy"] is None and rows[1]["error"] == "boom"
    assert rows[0]["accuracy"] is not None and rows[0]["error"] is None
    n = pts.count()
    assert rows[0]["n_test"] == n - folds.where("fold = 0").count()


def test_lost_job_is_no_failed_fold(spark):
    from panelstats.operators import model as mdl
    folds = spark.createDataFrame([(1.0, 0.0, 0), (2.0, 1.0, 1)], "a double, y double, fold int")

    def fit(train):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        mdl.cross_validate(folds, ["a"], "y", fit, 2)


def test_planted_label_is_learned(spark):
    """A label that the scores decide is learned: F1 of at least 0.95 on the hold-out."""
    from panelstats.operators import metrics, model as mdl
    from panelstats.operators.sampling import stratified_split
    points = M._points(spark, SMALL)
    cut = points.approxQuantile("l_quantity_mean", [0.5], 0.01)[0]
    points = points.withColumn("label", (F.col("l_quantity_mean") > cut).cast("double"))
    s = stratified_split(points, "point_id", "label", 0.3, 667)
    m = mdl.fit_boosted(s.where("split = 'train'"), M.BOOSTED_FEATURES, "label", maxIter=10, maxDepth=3, seed=1)
    scored = m.transform(s.where("split = 'test'")).select(F.col("label").cast("int"), F.col("prediction").cast("int"))
    f1 = {r["class"]: r["f1_score"] for r in metrics.classification_report(scored, "label", "prediction").collect()}
    assert f1["1"] >= 0.95 and f1["0"] >= 0.95


def test_missingness_is_learned(spark):
    """Where a missing score tells the label, a model with indicators sees it."""
    from panelstats.operators import model as mdl
    rows = [(None if i % 3 == 0 else float(i % 5), float(i % 7), float(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    right = lambda m: mdl.accuracy(m.transform(df), "y").first()["accuracy"]
    assert right(mdl.fit_tree(df, ["a", "b"], "y", 3, missing_indicators=True)) == 1.0
    assert right(mdl.fit_tree(df, ["a"], "y", 1)) < 1.0


def test_search_space_is_clamped_before_drawing():
    from panelstats.operators import model as mdl
    draws = mdl.sample_space(mdl.clamped_space(mdl.REFERENCE_SPACE), 300, 1)
    depths = [d["max_depth"] for d in draws]
    assert min(depths) >= 2 and max(depths) <= 30 and depths.count(30) < 40
    assert max(d["learning_rate"] for d in draws) <= 1.0


def test_parameter_grid():
    from panelstats import constants as K
    from panelstats.operators import model as mdl
    assert mdl.parameter_grid(K.MULTICLASS_GRID) == [
        {"maxIter": 100, "maxDepth": 10, "stepSize": 0.3, "featureSubsetStrategy": "0.9000", "subsamplingRate": 0.9,
         "minInstancesPerNode": 1, "minInfoGain": 0.0}]
    assert len(mdl.parameter_grid({"max_depth": [2, 3], "eta": [0.1, 0.2, 0.3]})) == 6


def test_explanation_ends_at_the_model_probability(spark):
    rows = E.queries()["explain_rows"](spark, SMALL).collect()
    assert len(rows) == 3
    for r in rows:
        assert r["text"].endswith(f"é {r['probability']:.2%}.")


def test_training_with_missing_scores(spark):
    from pyspark.ml import Pipeline
    from panelstats.operators import model as mdl
    rows = [(float(i % 7) if i % 5 else None, float(i % 3), 1.0 if i % 7 > 3 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fitted = Pipeline(stages=mdl.preparation(["a", "b"], missing_indicators=True)
                      + [mdl.tree_classifier("y", max_depth=3)]).fit(df)
    out = fitted.transform(df)
    assert out.count() == 200 and out.where("prediction IS NULL").count() == 0
    assert len(out.select("features").first()[0]) == 4
