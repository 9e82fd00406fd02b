from pyspark.sql import functions as F

from panelstats.operators.sampling import fold_rows, split_sizes, stratified_folds, stratified_split


def _data(spark):
    rows = [(i, "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else "small")) for i in range(1003)]
    return spark.createDataFrame(rows, "k long, c string")


def test_split_is_exact_disjoint_and_complete(spark):
    df = _data(spark)
    s = stratified_split(df, "k", "c", 0.3, 667)
    assert s.count() == 1003 and s.select("k").distinct().count() == 1003
    sizes = {r["split"]: r["n"] for r in split_sizes(s).collect()}
    assert sizes["test"] == 301 and sizes["train"] == 702   # ceil(0.3 * 1003) = 301
    per = s.groupBy("c").agg(F.avg((F.col("split") == "test").cast("double")).alias("share"),
                             F.count("*").alias("n")).collect()
    for r in per:
        assert abs(r["share"] * r["n"] - 0.3 * r["n"]) <= 1.0


def test_split_is_seeded(spark):
    df = _data(spark)
    a = {r["k"] for r in stratified_split(df, "k", "c", 0.3, 667).where("split = 'test'").collect()}
    b = {r["k"] for r in stratified_split(df, "k", "c", 0.3, 667).where("split = 'test'").collect()}
    c = {r["k"] for r in stratified_split(df, "k", "c", 0.3, 1).where("split = 'test'").collect()}
    assert a == b and a != c


def test_folds_balanced(spark):
    f = stratified_folds(_data(spark), "k", "c", 5, 667)
    counts = f.groupBy("fold").count().collect()
    assert max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1
    per = f.groupBy("c", "fold").count().groupBy("c").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in per)
    assert fold_rows(f, 2).count() + fold_rows(f, 2, held_out=False).count() == 1003


def test_quotas_reproduce_the_published_hold_out(spark):
    from panelstats.operators.sampling import split_quotas
    # 460 labelled points, 307 positive and 153 negative: the published hold-out has
    # 138 rows, 92 positive (TP+FN) and 46 negative (TN+FP)
    sizes = spark.createDataFrame([(1, 307), (0, 153)], "label int, group_n long")
    q = {r["label"]: (r["train_n"], r["test_n"]) for r in split_quotas(sizes, "label", 0.3).collect()}
    assert q == {1: (215, 92), 0: (107, 46)}


def test_test_size_rounds_up_like_scikit_learn(spark):
    import math

    from panelstats.operators.sampling import split_quotas
    # test size is ceil(share * n) in double arithmetic, as scikit-learn computes it
    ns = [7, 10, 13, 33, 457, 1003, 15000]
    sizes = spark.createDataFrame([(str(n), n) for n in ns], "c string, group_n long")
    for n in ns:
        one = sizes.where(f"c = '{n}'")
        assert split_quotas(one, "c", 0.3).first()["test_n"] == math.ceil(0.3 * n)


def test_ranks_shuffle_the_rows_once(spark):
    """whatever is broadcast, rows meet their cell's offset in the shuffle that sorts them."""
    from hashlib import md5

    from panelstats.operators.ranking import ranked_in_groups
    rows = [(i if i % 50 else None, [None, 0.0, 1.5][i % 3], "x" * 30) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g double, wide string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked, sizes = ranked_in_groups(df, ["g"], F.md5(F.col("k").cast("string")), ["k"])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # the counts of cells, and the rows
    want = {}
    for g in (None, 0.0, 1.5):  # rows without a hash count, and have no position
        here = [k for k, h, _ in rows if h == g]
        for i, k in enumerate(sorted((k for k in here if k is not None), key=lambda k: md5(str(k).encode()).hexdigest())):
            want[k] = (g, here.count(None) + i + 1)
    assert {r["k"]: (r["g"], r["rank"]) for r in ranked.collect()} == want
    assert {r["g"]: r["group_n"] for r in sizes.collect()} == {None: 1000, 0.0: 1000, 1.5: 1000}


def test_folds_by_a_computed_key(spark):
    df = _data(spark)
    by_name = {r["k"]: r["fold"] for r in stratified_folds(df, "k", "c", 5, 667).collect()}
    assert by_name == {r["k"]: r["fold"] for r in stratified_folds(df, F.col("k") + 0, "c", 5, 667).collect()}
