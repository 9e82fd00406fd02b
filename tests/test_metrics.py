from panelstats.operators.metrics import classification_report, confusion_matrix


def _published(spark):
    # TP=91, FN=1, TN=46, FP=0 (the hold-out behind the reference's published rates)
    rows = [(1, 1)] * 91 + [(1, 0)] * 1 + [(0, 0)] * 46
    return spark.createDataFrame(rows, "y int, p int")


def test_report_reproduces_published_rates(spark):
    r = {x["class"]: x for x in classification_report(_published(spark), "y", "p").collect()}
    assert round(r["1"]["precision"], 4) == 1.0 and round(r["1"]["recall"], 4) == 0.9891
    assert round(r["1"]["f1_score"], 4) == 0.9945
    assert round(r["0"]["precision"], 4) == 0.9787 and round(r["0"]["recall"], 4) == 1.0
    assert round(r["0"]["f1_score"], 4) == 0.9892
    assert round(r["accuracy"]["f1_score"], 4) == 0.9928 and r["accuracy"]["support"] == 138
    assert r["1"]["support"] == 92 and r["0"]["support"] == 46


def test_confusion_matrix(spark):
    rows = {r["prediction"]: r for r in confusion_matrix(_published(spark), "y", "p", [0, 1]).collect()}
    assert (rows["1"]["ref_1"], rows["1"]["ref_0"], rows["0"]["ref_1"], rows["0"]["ref_0"]) == (91, 0, 1, 46)
    assert abs(rows["0"]["accuracy"] - 137 / 138) < 1e-12
