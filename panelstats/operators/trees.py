"""Structure of fitted trees: node tables, root paths and readable rules.

A fitted ``spark.ml`` tree model is written with its own ``write().save`` to the shared folder and
its node table read back with ``spark.read.parquet`` (the documented persistence layout:
one row per node with ``id``, ``prediction``, ``impurityStats``, ``rawCount``,
``leftChild``, ``rightChild`` and ``split``; ensembles add ``treeID``).  Root paths come from
pointer doubling: every node knows an ancestor and the conditions up to it, and each round
joins it with that ancestor, so the rounds are the logarithm of the depth and neither trees nor
paths pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
import weakref
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.session import shared_path, written


_NODES: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def node_table(spark: SparkSession, tree_model) -> pd.DataFrame:
    """Nodes of a fitted tree or tree ensemble as a small pandas table.

    Read once per fitted model object (models fitted from one estimator share a uid, so
    the object itself is the key)."""
    try:
        return _NODES[tree_model]
    except (KeyError, TypeError):
        pass
    nodes = _read_nodes(spark, tree_model)
    try:
        _NODES[tree_model] = nodes
    except TypeError:
        pass
    return nodes


def node_rows(spark: SparkSession, tree_model) -> DataFrame:
    """(treeID, id, prediction, impurity, impurityStats, rawCount, leftChild, rightChild, feature,
    threshold, numCategories) of a fitted tree or ensemble."""
    path = shared_path(spark, "models", "tree_nodes")
    tree_model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.select(F.lit(0).alias("treeID"), "*")
    return data.select("treeID", "id", "prediction", "impurity", "impurityStats", "rawCount",
                       "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                       F.col("split.leftCategoriesOrThreshold").alias("threshold"),
                       F.col("split.numCategories").alias("numCategories"))


def _read_nodes(spark: SparkSession, tree_model) -> pd.DataFrame:
    return node_rows(spark, tree_model).toPandas()


def _cover(node: dict, regression: bool) -> float:
    """Training cover of a node: the weighted count for regression trees (first variance
    statistic, so sample weights count), else the raw row count."""
    stats = node["impurityStats"]
    if regression and stats is not None and len(stats) and stats[0] > 0:
        return float(stats[0])
    return float(node["rawCount"])


@dataclass
class Leaf:
    tree: int
    node: int
    value: float                     # leaf output on the explained scale, weight included
    features: list[int] = field(default_factory=list)
    lo: list[float] = field(default_factory=list)     # x > lo
    hi: list[float] = field(default_factory=list)     # x <= hi
    z: list[float] = field(default_factory=list)      # share of training cover kept
    conditions: list[tuple[int, str, float]] = field(default_factory=list)
    rows: int = 0
    impurity: float = 0.0
    missing: list[bool] = field(default_factory=list)  # whether the path takes missing values, per feature


def leaves(nodes: pd.DataFrame, weights: Sequence[float] | None = None, scale: float = 1.0,
           regression: bool = True) -> list[Leaf]:
    """Every leaf with its merged path: per feature the interval ``(lo, hi]`` the path
    allows and the product ``z`` of child/parent training cover along it."""
    out = []
    for tree_id, t in nodes.groupby("treeID", sort=True):
        by_id = {int(r["id"]): dict(r) for _, r in t.iterrows()}
        w = 1.0 if weights is None else float(weights[int(tree_id)])
        root = min(by_id)
        stack = [(root, {}, [])]
        while stack:
            nid, path, conds = stack.pop()
            n = by_id[nid]
            if int(n["leftChild"]) < 0:
                feats = sorted(path)
                out.append(Leaf(int(tree_id), nid, scale * w * float(n["prediction"]), feats,
                                [path[f][0] for f in feats], [path[f][1] for f in feats],
                                [path[f][2] for f in feats], conds, int(n["rawCount"]), float(n["impurity"])))
                continue
            if int(n["numCategories"]) >= 0:
                raise NotImplementedError("categorical splits are not supported; all features are numeric")
            f, thr = int(n["feature"]), float(n["threshold"][0])
            cover = _cover(n, regression)
            left, right = by_id[int(n["leftChild"])], by_id[int(n["rightChild"])]
            for child, go_left in ((left, True), (right, False)):
                lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
                lo, hi = (lo, min(hi, thr)) if go_left else (max(lo, thr), hi)
                p = dict(path)
                p[f] = (lo, hi, z * (_cover(child, regression) / cover if cover > 0 else 0.0))
                stack.append((int(child["id"]), p, conds + [(f, "<=" if go_left else ">", thr)]))
    return out


def root_paths(edges: DataFrame) -> DataFrame:
    """(tree, node, conditions) for every node of ``edges`` (tree, node, parent, condition; the
    root's parent is NULL): the conditions from the root down, by pointer doubling."""
    state = written(edges.select("tree", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.array().cast("array<string>"))
                                 .otherwise(F.array("condition")).alias("conditions")), "tree-paths")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("conditions").alias("before"))
        state = written(state.join(above, ["tree", "up"], "left").select(
            "tree", "node", F.col("further").alias("up"), F.concat(F.coalesce("before", F.array().cast("array<string>")), "conditions").alias("conditions")),
            "tree-paths")
    return state.select("tree", "node", "conditions")


def tree_nodes(spark: SparkSession, tree_model, features: Sequence[str]) -> DataFrame:
    """Every node of a fitted classification tree or ensemble, as a drawn tree shows it: ``(tree,
    node, depth, rule, is_leaf, feature, threshold, impurity, rows, class_rows, prediction)``;
    the rule is the conditions on the way from the root, joined by AND."""
    nodes = written(node_rows(spark, tree_model), "tree-nodes")
    names = F.array(*[F.lit(f) for f in features])
    name = F.get(names, F.col("feature"))
    limit = F.get("threshold", F.lit(0))
    inner = nodes.where("leftChild >= 0")
    # thresholds with all their digits, so that a rule sends every row where the tree does
    sides = inner.select(F.col("treeID").alias("tree"), F.col("id").alias("parent"), F.explode(F.array(
        F.struct(F.col("leftChild").alias("node"), F.concat(name, F.lit(" <= "), limit.cast("string"), F.lit("D")).alias("condition")),
        F.struct(F.col("rightChild").alias("node"), F.concat(name, F.lit(" > "), limit.cast("string"), F.lit("D")).alias("condition")))).alias("e")
    ).select("tree", "parent", "e.*")
    roots = nodes.select(F.col("treeID").alias("tree"), F.col("id").alias("node")).join(sides.select("tree", "node"), ["tree", "node"], "left_anti")
    edges = sides.unionByName(roots.withColumns({"parent": F.lit(None).cast("int"), "condition": F.lit(None).cast("string")}))
    paths = root_paths(edges)
    is_leaf = F.col("leftChild") < 0
    return nodes.join(paths, (nodes["treeID"] == paths["tree"]) & (nodes["id"] == paths["node"])).select(
        "tree", "node", F.size("conditions").alias("depth"), F.when(F.size("conditions") > 0, F.array_join("conditions", " AND ")).otherwise("TRUE").alias("rule"),
        is_leaf.alias("is_leaf"), F.when(~is_leaf, name).alias("feature"), F.when(~is_leaf, limit).alias("threshold"), "impurity",
        F.col("rawCount").alias("rows"), F.transform("impurityStats", lambda x: x.cast("long")).alias("class_rows"), "prediction")


def tree_rules(spark: SparkSession, tree_model, features: Sequence[str]) -> DataFrame:
    """One row per leaf: ``(tree, leaf, rule, prediction, rows, impurity)``."""
    return tree_nodes(spark, tree_model, features).where("is_leaf").select(
        "tree", F.col("node").alias("leaf"), "rule", "prediction", "rows", "impurity").orderBy("tree", "leaf")
