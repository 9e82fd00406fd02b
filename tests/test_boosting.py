"""The histogram booster against closed forms, brute force and planted labels."""

from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelstats.operators import boosting as B
from panelstats.operators import treeshap


def frame(spark, n=600, seed=1, parts=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    miss = rng.random(n) < 0.2
    y = ((a > 0.2) & (b < 0.5) | miss).astype(int)
    rows = [(i, None if m else float(x), float(v), float("nan") if i % 9 == 0 else float(w), int(t), i % 4)
            for i, (x, v, w, t, m) in enumerate(zip(a, b, c, y, miss))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(parts)


FEATURES = ["a", "b", "c"]


def leaf_rows(model, spark):
    return sorted(tuple(r) for r in model.nodes(spark).select("round", "output", "rows", F.round("value", 12), F.round("gain", 9), "feature", "threshold",
                                                              "default_left", "is_leaf").fillna({"feature": "", "threshold": 0.0, "default_left": False}).collect())


@pytest.mark.parametrize("g, h, alpha, lam, value", [(6.0, 2.0, 0.0, 1.0, -2.0), (-6.0, 2.0, 1.5, 1.0, 1.5), (1.0, 2.0, 1.5, 1.0, 0.0), (4.0, 0.0, 0.0, 2.0, -2.0)])
def test_leaf_values_equal_the_closed_form(g, h, alpha, lam, value):
    p = B.Params(learning_rate=0.5, reg_alpha=alpha, reg_lambda=lam)
    assert B.leaf_value(g, h, p) == pytest.approx(0.5 * value)


def best_by_force(bins, g, h, p):
    """Best (gain, feature, bin, default_left) over every split of one node."""
    def s(x, y):
        t = np.sign(x) * max(abs(x) - p.reg_alpha, 0)
        return t * t / (y + p.reg_lambda)
    found = []
    for f in range(bins.shape[1]):
        for default in (False, True):
            for b in sorted(set(bins[:, f]) - {B.MISSING}):
                left = np.where(bins[:, f] == B.MISSING, default, bins[:, f] <= b)
                if left.all() or not left.any() or min(h[left].sum(), h[~left].sum()) < p.min_child_weight:
                    continue
                gain = s(g[left].sum(), h[left].sum()) + s(g[~left].sum(), h[~left].sum()) - s(g.sum(), h.sum())
                found.append((gain, f, int(b), default))
    return max((x[0] for x in found), default=-np.inf), found


def test_splits_equal_brute_force_both_ways():
    rng = np.random.default_rng(3)
    for case in range(60):
        n = int(rng.integers(2, 60))
        bins = rng.integers(0, 6, (n, 2)).astype(np.uint8)
        bins[rng.random((n, 2)) < 0.2] = B.MISSING
        g = np.rint(rng.normal(size=n) * 64) / 64
        h = np.rint(rng.random(n) * 64) / 64
        p = B.Params(reg_alpha=float(case % 3), reg_lambda=float(case % 2), min_child_weight=[0.0, 1.0][case % 2])
        top, _ = best_by_force(bins, g, h, p)
        hist = np.array([[np.bincount(bins[:, f], w, 256) for f in range(2)] for w in (g, h, np.ones(n))])
        order = [np.argsort(bins[:, f], kind="stable") for f in range(2)]
        by_hist, tot = B.best_from_histogram(hist, np.ones(2, bool), p)
        by_rows, tot2 = B._best_from_rows(bins, g, h, np.zeros(n, int), 1, order, np.ones(2, bool), p)
        assert tot == pytest.approx(tot2[:, 0])
        for s in (by_hist, by_rows):
            assert s.gain[0] == pytest.approx(top) or (s.gain[0] == top)
            if np.isfinite(top):
                left = B.goes_left(bins[:, s.feature[0]], s.bin[0], s.default_left[0])
                assert (g[left].sum(), h[left].sum(), left.sum()) == pytest.approx((s.gl[0], s.hl[0], s.nl[0]))
        assert (by_hist.feature[0], by_hist.bin[0], by_hist.default_left[0]) == (by_rows.feature[0], by_rows.bin[0], by_rows.default_left[0])


def test_histograms_and_finished_nodes_give_one_tree(spark):
    df = frame(spark)
    p = B.Params(n_estimators=3, max_depth=5, reg_alpha=0.3, subsample=0.8, colsample_bytree=0.7, seed=5)
    whole = leaf_rows(B.fit(df, FEATURES, "y", p), spark)
    assert whole == leaf_rows(B.fit(df, FEATURES, "y", p, finish_rows=40), spark)
    assert whole == leaf_rows(B.fit(df, FEATURES, "y", p, finish_rows=0), spark)
    assert max(r[0] for r in whole) == 2 and len(whole) > 12


def test_missing_values_choose_a_side(spark):
    """A label that only missingness tells is learned at depth 1."""
    rows = [(i, None if i % 3 == 0 else float(i % 5), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, y int")
    m = B.fit(df, ["a"], "y", B.Params(n_estimators=10, max_depth=1))
    assert B.score(m, df, ["y"]).where("y <> prediction").count() == 0
    df2 = df.withColumn("y", F.when(F.col("a").isNull() | (F.col("a") >= 3), 1).otherwise(0))
    m2 = B.fit(df2, ["a"], "y", B.Params(n_estimators=10, max_depth=1))
    assert B.score(m2, df2, ["y"]).where("y <> prediction").count() == 0


def test_softmax_learns_bands_and_adds_up(spark):
    rows = [(i, float(i % 100), float(i % 7), int(i % 100) // 20) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    m = B.fit(df, ["a", "b"], "y", B.Params(n_estimators=15, max_depth=4), n_classes=5)
    out = B.score(m, df, ["y"])
    assert out.where("y <> prediction").count() == 0
    sums = out.select(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b) - 1).alias("d"), F.size("probabilities").alias("k"))
    assert sums.where("d > 1e-12 OR k <> 5").count() == 0


def test_search_and_folds_find_a_planted_label(spark):
    df = frame(spark, 800)
    draws = [{"max_depth": 5, "learning_rate": 0.3, "reg_alpha": 1e-3, "reg_lambda": 1.0, "scale_pos_weight": 1.0},
             {"max_depth": 2, "learning_rate": 1e-4, "reg_alpha": 9.0, "reg_lambda": 9.0, "scale_pos_weight": 50.0}]
    best, table, done = B.search(df, FEATURES, "y", "fold", 4, draws, 20, id_col="id")
    rows = {r["candidate"]: r for r in table.collect()}
    assert rows[0]["is_best"] and rows[0]["mean_f1"] >= 0.95 > rows[1]["mean_f1"] and best.max_depth == 5
    said = done.held_out().where("model < 4")
    assert said.select("id").distinct().count() == said.count() == 800 and said.where("fold <> model").count() == 0
    per, said = B.cross_validate(df, FEATURES, "y", B.Params(n_estimators=20, max_depth=5), 2, 4, id_col="id")
    assert sum(r["n_test"] for r in per.collect()) == 800 and all(r["accuracy"] > 0.93 for r in per.collect())
    assert said.where("prediction = label").count() > 760
    inverted, _ = B.cross_validate(df, FEATURES, "y", B.Params(n_estimators=3, max_depth=3), 2, 4, id_col="id", invert=True)
    assert sum(r["n_test"] for r in inverted.collect()) == 2400


def test_models_together_equal_models_alone(spark):
    df = frame(spark)
    ps = [B.Params(n_estimators=3, max_depth=3), B.Params(n_estimators=2, max_depth=4, learning_rate=0.1, scale_pos_weight=7.0, seed=2, colsample_bytree=0.5)]
    done = B.train(df, FEATURES, "y", ps)
    for i, p in enumerate(ps):
        assert leaf_rows(done.model(i), spark) == leaf_rows(B.fit(df, FEATURES, "y", p), spark)


def test_partitions_do_not_matter(spark):
    p = B.Params(n_estimators=3, max_depth=4)
    assert leaf_rows(B.fit(frame(spark, parts=1), FEATURES, "y", p), spark) == leaf_rows(B.fit(frame(spark, parts=9), FEATURES, "y", p), spark)


def test_saved_model_scores_alike(spark, tmp_path):
    df = frame(spark)
    m = B.fit(df, FEATURES, "y", B.Params(n_estimators=4, max_depth=3))
    again = B.load(spark, B.save(m, str(tmp_path / "m"), spark))
    assert B.score(m, df, ["id"]).exceptAll(B.score(again, df, ["id"])).count() == 0


def test_odd_training_tables(spark):
    schema = "id long, a double, y int"
    with pytest.raises(ValueError):
        B.fit(spark.createDataFrame([], schema), ["a"], "y")
    with pytest.raises(ValueError):
        B.fit(spark.createDataFrame([(1, 1.0, 2)], schema), ["a"], "y")
    one = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, 1.0, None)], schema)  # one class, nothing to split
    m = B.fit(one, ["a"], "y", B.Params(n_estimators=2))
    assert B.score(m, one, ["id"]).where("prediction <> 1").count() == 0 and m.nodes(spark).count() == 2


def expected(pieces, x, subset, path="", i=0):
    p = pieces[path]
    left, right = int(p["left"][i]), int(p["right"][i])
    if left == -1:
        return float(p["value"][i])
    f = int(p["feature"][i])
    steps = [(path + "L", 0), (path + "R", 0)] if left == B.OPEN else [(path, left), (path, right)]
    covers = [p["hess"][k] for k in ((1, 2) if left == B.OPEN else (left, right))]
    if f in subset:
        return expected(pieces, x, subset, *steps[0 if B.goes_left(x[f:f + 1], p["bin"][i], p["default_left"][i])[0] else 1])
    a, b = (expected(pieces, x, subset, *s) for s in steps)
    return (covers[0] * a + covers[1] * b) / (covers[0] + covers[1])


@pytest.mark.parametrize("finish_rows, pattern_features", [(65_536, 8), (100, 8), (100, 1)])
def test_attribution_equals_brute_force_through_default_branches(spark, monkeypatch, finish_rows, pattern_features):
    monkeypatch.setattr(treeshap, "PATTERN_FEATURES", pattern_features)
    df = frame(spark, 300)
    m = B.fit(df, FEATURES, "y", B.Params(n_estimators=3, max_depth=4), finish_rows=finish_rows)
    att = treeshap.attribute(m, df, "id", FEATURES)
    trees = [pieces for r in B.read_pieces(m.folder).values() for pieces in r.values()]
    sample = df.where("id < 25").toPandas()
    got = {(r["id"], r["feature"]): r for r in att.where("id < 25").collect()}
    for _, row in sample.iterrows():
        x = B.binned(row[FEATURES].to_numpy(dtype=float)[None], m.cuts)[0]

        def v(s):
            return sum(expected(t, x, s) for t in trees)
        for i, name in enumerate(FEATURES):
            rest = [j for j in range(3) if j != i]
            phi = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (v({*s, i}) - v(set(s))) for k in range(3) for s in combinations(rest, k))
            assert got[row["id"], name]["contribution"] == pytest.approx(phi, abs=1e-9)
            assert got[row["id"], name]["base"] == pytest.approx(m.base + v(set()), abs=1e-9)
    margin = m.margins(df, ["id"]).select("id", F.get("margin", F.lit(0)).alias("margin"))
    total = att.groupBy("id").agg((F.max("base") + F.sum("contribution")).alias("t"))
    assert total.join(margin, "id").where(F.abs(F.col("t") - F.col("margin")) > 1e-9).count() == 0
    assert att.where("feature = 'a' AND value IS NULL").count() == df.where("a IS NULL").count()


def test_a_task_sends_one_histogram_per_node():
    """However many batches a task reads, and equal to the histogram of all its rows at once."""
    rng = np.random.default_rng(2)
    n = 900
    bins = rng.integers(0, 20, (n, 2)).astype(np.uint8)
    plan = B.Plan((B.Params(),), (-1,), False, (0.0,), 1, 2, 0)
    label = rng.integers(0, 2, n).astype(np.int32)
    whole = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(label), pa.array(np.full(n, -2, np.int32)), pa.array([b.tobytes() for b in bins], pa.binary()),
         pa.array([np.zeros(1).tobytes()] * n, pa.binary())], ["row", "label", "fold", "bins", "margin"])
    batches = [whole.slice(a, 100) for a in range(0, n, 100)]
    split = {k: np.array([v]) for k, v in {"feature": 0, "bin": 9, "default_left": False, "left": B.OPEN, "right": B.OPEN, "value": 0.0}.items()}
    sent = [r for b in B._emit(plan, 0, [], {0: {"": split}}, {0: {"L": False, "R": False}})(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["path"] for r in sent) == ["L", "R"]
    for r in sent:
        here = (bins[:, 0] <= 9) == (r["path"] == "L")
        assert np.frombuffer(r["payload"]).reshape(3, 2, 256)[2, 1].tolist() == np.bincount(bins[here, 1], minlength=256).tolist()


@pytest.mark.parametrize("outputs, finish_rows", [(1, 1 << 20), (1, 0), (3, 60)])
def test_rounds_of_a_barrier_stage_equal_jobs_per_level(spark, monkeypatch, outputs, finish_rows):
    """Many rounds are one stage, and its tasks grow the trees that a job per level grows."""
    df = frame(spark).withColumn("k", F.when(F.col("y") == 0, F.pmod("id", F.lit(2))).otherwise(2).cast("int"))
    label, classes = ("y", 2) if outputs == 1 else ("k", 3)
    p = B.Params(n_estimators=7, max_depth=4, reg_alpha=0.3, subsample=0.8, colsample_bytree=0.7, seed=5)
    monkeypatch.setattr(B, "ROW_TREES", 150)
    monkeypatch.setattr(B, "ROUNDS", 4)
    grown = {}
    for held in (1 << 30, 0):
        monkeypatch.setattr(B, "HELD_BYTES", held)
        done = B.train(df, FEATURES, label, [p], classes, id_col="id", fold_col="fold", folds=2, finish_rows=finish_rows)
        margins = sorted((r["id"], bytes(r["margin"])) for r in done.state.collect())
        grown[held] = [leaf_rows(done.model(i), spark) for i in range(2)], margins
    assert grown[0] == grown[1 << 30] and len(grown[0][1]) == 600


def test_jobs_do_not_grow_with_the_rounds(spark, monkeypatch):
    """12 rounds take as many Spark jobs as 2."""
    df, sc, jobs = frame(spark), spark.sparkContext, []
    monkeypatch.setattr(B, "ROW_TREES", 150)
    for n in (2, 12):
        sc.setJobGroup(f"rounds-{n}", "")
        B.train(df, FEATURES, "y", [B.Params(n_estimators=n, max_depth=3)])
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_rows_walk_a_tree_as_one_by_one():
    """All rows take a step together; leaves at different depths, missing values, open nodes."""
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 9, (4000, 3)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.2] = B.MISSING
    g, h = np.rint(rng.normal(size=4000) * 64) / 64, np.full(4000, 0.25)
    piece = B.grow(bins, g, h, 6, np.ones(3, bool), B.Params(gamma=1.0))
    rest = {n: piece[n][:1].copy() for n in B.FIELDS}
    rest["left"][0] = B.OPEN
    low = B.goes_left(bins[:, rest["feature"][0]], rest["bin"][0], rest["default_left"][0])
    below = {side: B.grow(bins[rows], g[rows], h[rows], 5, np.ones(3, bool), B.Params(gamma=1.0)) for side, rows in (("L", low), ("R", ~low))}

    def one(p, row):
        i = 0
        while p["left"][i] >= 0:
            i = int(p["left" if B.goes_left(row[p["feature"][i]:][:1], p["bin"][i], p["default_left"][i])[0] else "right"][i])
        return p["value"][i]
    want = [one(piece, row) for row in bins]
    assert len(piece["left"]) > 20 and B.Tree({"": piece}).values(bins).tolist() == want
    assert B.Tree({"": rest, **below}).values(bins) == pytest.approx(want)
    assert B.Tree({"": piece}).values(np.asfortranarray(bins)).tolist() == want


@pytest.mark.parametrize("alpha, lam, least, share", [(0.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.2), (0.5, 1.0, 0.5, 0.2)])
def test_nodes_are_split_together_as_one_by_one(monkeypatch, alpha, lam, least, share):
    """The splits of many nodes over all features at once, and of one feature at a time."""
    rng = np.random.default_rng(6)
    n, nodes = 4000, 37
    bins, node = rng.integers(0, 40, (n, 3)).astype(np.uint8), rng.integers(0, nodes, n)
    bins[rng.random(bins.shape) < share] = B.MISSING
    bins[node == 5] = 7                                              # a node without any split
    g, h = np.rint(rng.normal(size=n) * 64) / 64, np.rint(rng.random(n) * 64) / 64
    p, allowed = B.Params(reg_alpha=alpha, reg_lambda=lam, min_child_weight=least), np.array([True, False, True])
    monkeypatch.setattr(B, "CACHE_CELLS", 5000)
    hist = B._cells(bins.T, g, h, node, nodes, allowed)
    order = [np.argsort(c, kind="stable") for c in bins.T]
    want, sums = B._best_from_rows(bins, g, h, node, nodes, order, allowed, p)
    got, tot = B.best_from_histograms(hist, allowed, p)
    slow = B._best_by_features(bins.T, g, h, node, nodes, allowed, p)
    found = np.isfinite(want.gain)
    assert tot.tolist() == sums.tolist() and 30 < found.sum() < nodes and not found[5]
    for name in vars(want):
        for s in (got, slow):
            assert getattr(s, name)[found].tolist() == getattr(want, name)[found].tolist()
    assert got.gain.tolist() == slow.gain.tolist() == want.gain.tolist()


def test_the_larger_child_has_what_the_smaller_leaves():
    """Only the smaller child of a pair is added up; an empty child too."""
    rng = np.random.default_rng(7)
    n = 3000
    bins, node = rng.integers(0, 256, (n, 3)).astype(np.uint8), rng.choice([0, 1, 2, 3, 4], n, p=[0.1, 0.4, 0.3, 0.1, 0.1])
    g, h, allowed = np.rint(rng.normal(size=n) * B.QUANTUM) / B.QUANTUM, np.rint(rng.random(n) * B.QUANTUM) / B.QUANTUM, np.array([True, True, False])
    above = B._cells(bins.T, g, h, node >> 1, 3, allowed)
    got = B._cells_of_pairs(above, bins.T, g, h, node, np.bincount(node, minlength=6), allowed)
    assert got.tolist() == B._cells(bins.T, g, h, node, 6, allowed).tolist()


def test_a_node_that_one_task_finishes_is_a_small_part_of_its_share():
    """Tasks get several nodes each, so none has twice the rows of another; small nodes are whole."""
    class Peers:
        tasks = 8
    plan = B.Plan((B.Params(max_depth=10),), (-1,), False, (0.0,), 5, 5, B.FINISH_ROWS)
    for rows, most in ((632_000, 632_000 * 5 // 8 // 4), (20_000, 20_000 * 5 // 8)):
        grower = B.Grower(plan, 0, Peers(), [rows])
        assert grower._finishes(0, "", most) and not grower._finishes(0, "", most + 5)


def scattered(spark, holes, n=900, seed=8):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    rows = [(i, float(x) if i % holes else None, float(v), float(w), int(x > 0.2 and v < 0.5 or w > 1), i % 3) for i, (x, v, w) in enumerate(zip(a, b, c))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(5)


@pytest.mark.parametrize("outputs, finish_rows, subsample", [(1, 0, 1.0), (3, 60, 0.7)])
def test_models_in_turn_equal_models_at_once(spark, monkeypatch, outputs, finish_rows, subsample):
    """a task holds the margins of a few models and the work of a few trees; the trees, margins and
    held-out predictions are those of all models and trees at once."""
    df = scattered(spark, 5 if outputs > 1 else 10_000).withColumn("k", F.when(F.col("y") == 0, F.pmod("id", F.lit(2))).otherwise(2).cast("int"))
    label, classes = ("y", 2) if outputs == 1 else ("k", 3)
    ps = [B.Params(n_estimators=n, max_depth=5, subsample=subsample, colsample_bytree=0.7, seed=5) for n in (2, 3)]
    monkeypatch.setattr(B, "ROW_TREES", 900)
    grown = {}
    room = (900 // 4 + 1) * (3 + 64 + 16 * 3 * outputs) + 900     # three models a task
    for held, batch, finish in ((1 << 30, 1 << 20, 1 << 20), (room, 150, finish_rows)):
        monkeypatch.setattr(B, "COUNT_ROWS", 0 if held == room else 1 << 18)
        monkeypatch.setattr(B, "HELD_BYTES", held)
        monkeypatch.setattr(B, "BATCH_ROWS", batch)
        done = B.train(df, FEATURES, label, ps, classes, id_col="id", fold_col="fold", folds=3, finish_rows=finish)
        margins = sorted((r["id"], bytes(r["margin"])) for r in done.state.select("id", "margin").collect())
        grown[held] = [leaf_rows(done.model(i), spark) for i in (0, 5)], margins, sorted(map(tuple, done.held_out().collect()))
        assert len(done.parts) == (2 if held == room else 1)
    assert grown[room] == grown[1 << 30] and len(grown[room][1]) == 900 and len(grown[room][2]) == 1800


def test_nodes_need_no_counts(monkeypatch):
    """Pair sums and sorted rows give the trees of counted histograms, whatever nodes are taken together, with missing
    values and rows without weight, and every row its leaf."""
    rng = np.random.default_rng(9)
    for case in range(18):
        n, f = int(rng.integers(1, 3000)), int(rng.integers(1, 4))
        bins = rng.integers(0, rng.integers(2, 255), (n, f)).astype(np.uint8)
        bins[rng.random(bins.shape) < [0, 0.2][case // 3 % 2]] = B.MISSING
        prob, y = rng.random(n), (bins[:, 0] > 40) ^ (rng.random(n) < 0.3)
        prob[rng.random(n) < [0, 0.5][case // 9]] = 1e-9
        g, h = np.rint((prob - y) * B.QUANTUM) / B.QUANTUM, np.rint(prob * (1 - prob) * B.QUANTUM) / B.QUANTUM
        p = B.Params(reg_alpha=0.3 * (case % 2), gamma=0.1 * (case % 4 == 1), min_child_weight=[1.0, 0.2][case % 2])
        for name, value in zip(("NODES", "SORTED_NODES", "CACHE_CELLS"), [(512, 256, 1 << 14), (4, 2, 300), (8, 16, 4000)][case % 3]):
            monkeypatch.setattr(B, name, value)
        piece, leaf = B.grown(np.ascontiguousarray(bins.T), g + 1j * h, 20, np.ones(f, bool), p)
        want = B._grow_counted(np.ascontiguousarray(bins.T), g, h, 20, np.ones(f, bool), p)

        def nodes(t, i=0, path=""):
            below = [nodes(t, int(t[s][i]), path + s[0]) for s in ("left", "right")] if t["left"][i] >= 0 else []
            return [(path, *(t[x][i] for x in ("feature", "bin", "default_left", "value", "hess", "rows", "gain"))), *(y for b in below for y in b)]
        assert nodes(piece) == nodes(want)
        assert (piece["left"][leaf] == -1).all() and (piece["value"][leaf] == B.Tree({"": want}).values(bins)).all()
        assert np.bincount(leaf, minlength=len(piece["rows"]))[piece["left"] < 0].tolist() == piece["rows"][piece["left"] < 0].tolist()


def test_rows_find_their_leaf_by_bits_as_step_by_step():
    """Trees of up to 64 leaves, also full ones, one leaf, missing values and pieces below open nodes."""
    rng = np.random.default_rng(10)
    bins = rng.integers(0, 256, (6000, 4)).astype(np.uint8)
    g, h = np.rint(rng.normal(size=6000) * 64) / 64, np.full(6000, 0.25)
    for depth, share in ((6, 1.0), (6, 0.0), (4, 1.0), (0, 1.0)):
        data = bins if share else np.minimum(bins, 254)
        tree = B.Tree({"": B.grow(data, g, h, depth, np.ones(4, bool), B.Params())})
        got = tree.values(bins)
        assert tree.masks is not None and (tree.whole["left"] < 0).sum() <= 1 << depth
        assert (got == tree.whole["value"].take(B._step_down(tree.whole, np.ascontiguousarray(bins.T)))).all()
