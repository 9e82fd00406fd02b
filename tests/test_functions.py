import math


from panelstats.functions import binary_label, ordinal_label, repair_date_score, sigmoid
from panelstats.functions.repair import was_date_repaired
from panelstats.functions.scalar import format_fixed, format_percent


def test_date_repair_cases(spark):
    raw = ["5.3", "2024-03-05 00:00:00", "2024-10-05 00:00:00", "2024-01-05 00:00:00", "7", "x", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, raw string")
    got = [r["v"] for r in df.select("i", repair_date_score("raw").alias("v")).orderBy("i").collect()]
    assert got == [5.3, 5.3, 5.1, 5.1, 7.0, None, None]
    rep = [r[0] for r in df.orderBy("i").select(was_date_repaired("raw")).collect()]
    assert rep == [False, True, True, True, False, False, False]


def test_cells_that_only_look_like_scores(spark):
    """Casts alone would read these: a time as today's date, a month as its first day, suffixed,
    hexadecimal and infinite numbers."""
    raw = ["12:30", "2024-3", "2024", "7d", "5f", "0x1p3", "Infinity", "-inf", "2024-02-30", "2024-3-5", "1,5", "", " 5.3 ", "1e1", "-.5",
           "5.", "2024-03-05", "2024-03-05T10:11:12.5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, raw string").orderBy("i")
    got = [tuple(r) for r in df.select(repair_date_score("raw"), was_date_repaired("raw")).collect()]
    none = (None, False)
    assert got == [none, none, (2024.0, False), none, none, none, none, none, none, none, none, none, (5.3, False), (10.0, False),
                   (-0.5, False), (5.0, False), (5.3, True), (5.3, True)]


def test_nan_text_is_missing(spark):
    df = spark.createDataFrame([("NaN",), ("nan",)], "raw string")
    assert [r[0] for r in df.select(repair_date_score("raw")).collect()] == [None, None]


def test_binary_label_missing_is_positive(spark):
    df = spark.createDataFrame([(0, "Não degradada"), (1, None), (2, "Degradação Moderada")], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(binary_label("c")).collect()]
    assert got == [0, 1, 1]
    kept = [r[0] for r in df.orderBy("i").select(binary_label("c", missing_is_positive=False)).collect()]
    assert kept == [0, None, 1]


def test_ordinal_label(spark):
    df = spark.createDataFrame([(0, "Degradação Biológica Severa"), (1, "Não degradada"), (2, "other"), (3, None)],
                               "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(ordinal_label("c")).collect()] == [4, 0, None, None]


def test_sigmoid_and_formats(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-1.5,)], "x double")
    rows = df.select(sigmoid("x").alias("p"), format_fixed("x").alias("f"),
                     format_percent(sigmoid("x")).alias("pct")).collect()
    for (x,), r in zip([(0.0,), (2.0,), (-1.5,)], rows):
        p = 1 / (1 + math.exp(-x))
        assert abs(r["p"] - p) < 1e-15
        assert r["f"] == f"{x:.2f}"
        assert r["pct"] == f"{p:.2%}"
