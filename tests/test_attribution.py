from panelstats.operators.attribution import attribution_path, attribution_text, attribution_total


def _contrib(spark):
    return spark.createDataFrame([(1, "a", 0.0, -3.0, 0.5), (1, "b", 0.0, 1.0, 0.5), (1, "c", 0.0, 2.0, 0.5),
                                  (2, "a", 0.0, 0.0, 0.5)], "id int, feature string, value double, "
                                                            "contribution double, base double")


def test_path_order_smallest_magnitude_first(spark):
    p = attribution_path(_contrib(spark)).where("id = 1").orderBy("step").collect()
    assert [r["contribution"] for r in p] == [1.0, 2.0, -3.0]
    assert [r["logodds"] for r in p] == [1.5, 3.5, 0.5]


def test_total(spark):
    t = {r["id"]: r["logodds"] for r in attribution_total(_contrib(spark)).collect()}
    assert t == {1: 0.5, 2: 0.5}


def test_text_zero_reads_decreased(spark):
    t = {r["id"]: r["text"] for r in attribution_text(_contrib(spark)).collect()}
    assert "'a' diminuiu o log-odds em 0.00 unidades" in t[2]
    assert t[1].startswith("O valor base (médio) de log-odds é de 0.50, o que corresponde a uma "
                           "probabilidade inicial de degradação igual a 62.25%.")
    assert t[1].endswith("Assim, a probabilidade final de que a pastagem está DEGRADADA é 62.25%.")
    assert t[1].index("'b' aumentou") < t[1].index("'c' aumentou") < t[1].index("'a' diminuiu")
