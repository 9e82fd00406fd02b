"""The source's analyses on its own column layout (a small generated panel)."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelstats import constants as K
from panelstats import workflows as W
from panelstats.operators import boosting

SCORES = ["Altura", "EstDesenv", "Invasoras", "Cupins", "CobertSolo", "DispForr", "DispFolhVerd", "CondAtual",
          "PotProd", "Degrad", "Manejo"]


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(3)
    rows, classes, seq = [], [], 0
    for p in range(60):
        cls = K.CLASS_ORDER[p % 5]
        classes.append((f"id{p}", f"P{p}", cls, -16.0 + rnd.random(), -49.0 + rnd.random()))
        for rater in range(3):
            seq += 1
            cells = []
            for s in SCORES:
                v = rnd.randint(1, 7) if s != "Altura" else rnd.choice([20, 30, 40])
                if s == "CobertSolo" and rnd.random() < 0.1:     # a spreadsheet turned 5.3 into a date
                    cells.append("2024-03-05 00:00:00")
                else:
                    cells.append(str(float(v + (p % 5 if s in ("Degrad", "PotProd") else 0))))
            rows.append((seq, f"P{p}", f"id{p}", datetime(2024, 1 + p % 9, 1 + rater), "campo", "eq", "sp",
                         f"r{rater}", *cells))
    schema = ("seq int, Ponto string, PontoID string, Data timestamp, Campo string, Equipe string, "
              "Especie01 string, Avaliador string, " + ", ".join(f"{s} string" for s in SCORES))
    raw = spark.createDataFrame(rows, schema)
    cls = spark.createDataFrame(classes, "PontoID string, Ponto string, CLASS_DED string, LAT double, LON double")
    return raw, cls


def test_reference_layout_end_to_end(spark, panel):
    raw, classes = panel
    typed = W.prepare_scores(raw, K.ID_COLUMNS + ["seq"])
    assert all(t == "double" for c, t in typed.dtypes if c in SCORES)
    assert typed.where("CobertSolo = 5.3").count() > 0

    feats = W.point_features(typed, id_columns=K.ID_COLUMNS + ["seq"])
    points = W.labelled_points(feats, classes)
    assert points.count() == 60
    features = W.model_features(points)
    assert len(features) == 9 and not any("Degrad" in f or "Manejo" in f for f in features)

    train, test = W.split(points)
    assert test.count() == 18 and train.count() == 42
    fitted = boosting.fit(train, features, "label", boosting.Params(n_estimators=5, max_depth=3))
    texts = W.explain(fitted, test, features).collect()
    assert len(texts) == 18 and all(r["text"].startswith("O valor base") for r in texts)
    tree = W.train_tree(train, ["CobertSolo_mean", "Invasoras_mean", "PotProd_mean"])
    assert tree.transform(test).count() == 18

    m = W.thematic_map(fitted, points, classes).collect()
    assert len(m) == 60 and {r["prediction_class"] for r in m} <= {"DEGRADADA", "NÃO DEGRADADA"}


def test_rater_views(spark, panel):
    raw, classes = panel
    typed = W.prepare_scores(raw, K.ID_COLUMNS + ["seq"])
    stats = W.point_features(typed, ["mean", "min", "max", "max_min_diff"], K.ID_COLUMNS + ["seq"])
    boxes = W.rater_ranges(W.labelled_points(stats, classes, whole_class_table=True))
    assert boxes.count() == len(SCORES)
    sd = W.rater_sd_over_time(typed, "seq", id_columns=K.ID_COLUMNS + ["seq"])
    assert sd.count() == 60 * (len(SCORES) - 1)  # ten scores, no height
    two = typed.withColumn("Especie01", F.when((F.col("Ponto") == "P0") & (F.col("Avaliador") != "r0"), "other")
                           .otherwise(F.col("Especie01")))
    fanned = W.rater_sd_over_time(two, "seq", id_columns=K.ID_COLUMNS + ["seq"])
    assert fanned.count() == 61 * (len(SCORES) - 1)  # a point with two species has two rows
    assert sd.columns == ["Ponto", "Data", "score", "sd"]
    full = W.full_join_for_map(typed, classes)
    assert "Ponto_left" in full.columns and "Ponto_right" in full.columns and full.count() == 180


def test_training_table_of_the_five_class_booster(spark, panel):
    raw, classes = panel
    typed = W.prepare_scores(raw, K.ID_COLUMNS + ["seq"]).withColumn("Altura", F.col("Altura").cast("string"))
    t = W.training_table(typed, classes, "seq", id_columns=K.ID_COLUMNS + ["seq"])
    assert t.count() == 60 and set(K.MULTICLASS_FEATURES) <= set(t.columns)
    folds = {r["fold"]: r["n"] for r in t.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert folds == dict.fromkeys(range(5), 12)
    names = {r["CLASS_DED"]: r["factor"] for r in t.collect()}
    assert [k for k, _ in sorted(names.items(), key=lambda x: x[1])] == sorted(K.CLASS_ORDER)
    fitted = W.train_multiclass(t, params=boosting.Params(n_estimators=10, max_depth=4, min_child_weight=0))
    assert boosting.score(fitted, t, ["factor"]).where("prediction = factor").count() > 50


def test_search_then_explain(spark, panel):
    raw, classes = panel
    typed = W.prepare_scores(raw, K.ID_COLUMNS + ["seq"])
    points = W.labelled_points(W.point_features(typed, id_columns=K.ID_COLUMNS + ["seq"]), classes)
    features = W.model_features(points)
    train, test = W.split(points)
    best, candidates = W.train_binary(train, features, n_candidates=2, max_iter=3, folds=3)
    assert candidates.count() == 2 and candidates.where("is_best").count() == 1
    assert W.explain(best, test, features).count() == test.count()
    # entered by hand, one score left out
    form = W.form_rows(spark, [{f: 4 for f in features}, {features[0]: 1.5}], features)
    assert form.columns == ["PontoID", *features] and form.where(F.col(features[1]).isNull()).count() == 1
    assert {r["PontoID"]: r["text"][:12] for r in W.explain(best, form, features).collect()} == {0: "O valor base", 1: "O valor base"}
