"""Tree attribution against brute-force Shapley values of the path-dependent game."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SMALL
from panelstats.operators import boosting, model, treeshap
from panelstats.operators.trees import node_table
from panelstats.plans import modelling as M


def _expect(tree, nid, x, S):
    n = tree[nid]
    if n["leftChild"] < 0:
        return n["prediction"]
    f, thr = int(n["feature"]), float(n["threshold"][0])
    l, r = tree[int(n["leftChild"])], tree[int(n["rightChild"])]
    if f in S:
        return _expect(tree, int(n["leftChild"]) if x[f] <= thr else int(n["rightChild"]), x, S)
    cl, cr = l["impurityStats"][0], r["impurityStats"][0]
    return (cl * _expect(tree, int(l["id"]), x, S) + cr * _expect(tree, int(r["id"]), x, S)) / (cl + cr)


def _brute(trees, weights, x, m):
    def v(S):
        return sum(2 * w * _expect(t, min(t), x, S) for t, w in zip(trees, weights))
    phi = np.zeros(m)
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for s in range(m):
            for S in combinations(rest, s):
                wgt = factorial(s) * factorial(m - s - 1) / factorial(m)
                phi[i] += wgt * (v(set(S) | {i}) - v(set(S)))
    return phi, v(set())


def test_matches_brute_force_and_is_locally_exact(spark):
    points = M._points(spark, SMALL)
    m = model.fit_boosted(points, M.BOOSTED_FEATURES, "label", maxIter=3, maxDepth=3, stepSize=0.5, seed=1)
    gbt = m.stages[-1]
    nodes = node_table(spark, gbt)
    trees = [{int(r["id"]): r for _, r in t.iterrows()} for _, t in nodes.groupby("treeID", sort=True)]
    att = treeshap.attribute(m, points, "point_id", M.BOOSTED_FEATURES)
    sample = att.where(F.col("point_id") < 40).toPandas()
    k = len(M.BOOSTED_FEATURES)
    for pid, g in sample.groupby("point_id"):
        g = g.set_index("feature").loc[M.BOOSTED_FEATURES]
        x = g["value"].to_numpy()
        phi, base = _brute(trees, list(gbt.treeWeights), x, k)
        assert np.allclose(g["contribution"].to_numpy(), phi, atol=1e-9)
        assert abs(g["base"].iloc[0] - base) < 1e-9
    tot = att.groupBy("point_id").agg((F.max("base") + F.sum("contribution")).alias("lo"))
    raw = m.transform(points).select("point_id", (2 * vector_to_array("rawPrediction")[1]).alias("margin"))
    err = tot.join(raw, "point_id").agg(F.max(F.abs(F.col("lo") - F.col("margin")))).first()[0]
    assert err < 1e-9


def test_bins_are_attributed_as_numbers_with_missing_ones():
    """rows of a booster stay small integers; paths of several lengths and features, open ends, missing values."""
    rng = np.random.default_rng(1)
    n = 3000
    bins = rng.integers(0, 255, (n, 4)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.1] = boosting.MISSING
    g, h = np.rint(rng.normal(size=n) * 64) / 64, np.full(n, 0.25)
    leaves = [lf for p in (boosting.Params(), boosting.Params(gamma=2.0))
              for lf in treeshap.tree_leaves({"": boosting.grow(bins, g, h, 6, np.ones(4, bool), p)})]
    numbers = np.where(bins == boosting.MISSING, np.nan, bins.astype(float))
    got = treeshap.shap_values(bins.astype(np.int16), leaves)
    want = np.zeros((n, 4))                # leaf by leaf, from the contributions of a path themselves
    for lf in leaves:
        if lf.features:
            x = numbers[:, lf.features].T
            inside = ((x > np.array(lf.lo)[:, None]) & (x <= np.array(lf.hi)[:, None])) | (np.isnan(x) & np.array(lf.missing)[:, None])
            parts = treeshap.path_contributions(np.array([lf.value]), np.maximum(np.array([lf.z]), 1e-12), inside[None].astype(float))
            want[:, lf.features] += parts[:, 0].T
    assert np.allclose(got, want, atol=1e-9) and (got == treeshap.shap_values(numbers, leaves)).all()
    assert len({len(lf.features) for lf in leaves}) > 2


def test_tables_of_a_tree_equal_its_leaves(monkeypatch):
    """A row is looked up once per feature and tree; trees of one to four features, missing values, open
    ends, and trees too large for tables."""
    rng = np.random.default_rng(2)
    n = 4000
    bins = rng.integers(0, 256, (n, 4)).astype(np.uint8)
    h = np.full(n, 0.25)
    for used, depth, holes in ((4, 6, True), (4, 6, False), (3, 5, True), (2, 4, True), (1, 3, True), (1, 1, False)):
        data = bins if holes else np.minimum(bins, 254)
        allowed = np.arange(4) >= 4 - used
        g = np.rint(rng.normal(size=n) * 64) / 64
        leaves = treeshap.tree_leaves({"": boosting.grow(data, g, h, depth, allowed, boosting.Params())})
        tree = treeshap.whole_tree(leaves)
        assert tree.features == [f for f in range(4) if allowed[f]][:len(tree.features)]
        got = np.zeros((n, 4))
        treeshap.TreeTables(tree).add(got, np.ascontiguousarray(data.T).astype(np.intp))
        assert np.allclose(got, treeshap.shap_values(data.astype(np.int16), leaves), atol=1e-10)
    monkeypatch.setattr(treeshap, "TABLE_CELLS", 1)
    assert treeshap.whole_tree(treeshap.tree_leaves({"": boosting.grow(bins, g, h, 6, np.ones(4, bool), boosting.Params())})) is None
