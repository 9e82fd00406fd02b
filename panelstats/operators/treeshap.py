"""Additive per-feature attribution of boosted-tree log-odds for a whole table.

Path-dependent tree SHAP (Lundberg, Erion & Lee, "Consistent individualized feature
attribution for tree ensembles", 2018), in a form that vectorises over rows:

for a leaf with value v whose path tests the features P (m = |P|, repeated tests of a
feature merged into one interval), a row x has o_j = 1 if x_j lies in the interval the
path allows and z_j = the share of training cover the path keeps at feature j.  Then

    phi_i(x) += v (o_i - z_i) sum_{S subset P minus i} |S|! (m-|S|-1)! / m!
                                  prod_{j in S} o_j prod_{j not in S, j != i} z_j
    base     += v prod_j z_j

The inner sum is read off the coefficients of prod_{j != i} (z_j + o_j t), which come from
the full product by dividing one factor out: O(m^2) array operations per chunk of leaves with
the same path length.  They depend on a row only by its m bits o_j, so for short paths they
are computed once per leaf for all 2^m patterns and looked up per row; long paths are computed
per row.  base + sum_i phi_i equals the model's log-odds for every row.

A booster's trees are summed up further.  With v_S(x) the expected leaf value of a tree whose features S are known,
phi_i = sum over S of c_i(S) v_S(x), where v_S depends on x only by the interval of each of the features in S
between the tree's own cuts.  The v_S of all S but the whole set are added up to one table for each feature left
out, over the intervals of the others; the whole set's v_S is the tree's value.  So a row costs a lookup per feature
and tree, not per leaf.  Trees whose tables would be large go by leaves as above.

Rows are streamed in Arrow batches, so the job scales with the table's partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.operators.boosting import FIELDS, MASK_LEAVES, MISSING, OPEN, BoostedModel, _chunks, _matrix, binned, numbers
from panelstats.operators.model import prepared
from panelstats.operators.trees import Leaf, leaves, node_table
from panelstats.session import file_system, shared_path, ship_package, spread_rows


def gbt_leaves(spark, gbt_model) -> list[Leaf]:
    """Leaves of a fitted ``GBTClassificationModel`` on the log-odds scale.

    Spark's margin is ``sum_t w_t tree_t(x)`` and the probability ``1/(1+exp(-2 margin))``,
    so each leaf value is scaled by ``2 w_t``.
    """
    return leaves(node_table(spark, gbt_model), list(gbt_model.treeWeights), scale=2.0, regression=True)


def expected_value(ls: Sequence[Leaf]) -> float:
    return float(sum(lf.value * float(np.prod(lf.z)) for lf in ls))


LEAF_CHUNK = 8        # leaves evaluated together; bounds the (leaves x depth x rows) arrays
PATTERN_FEATURES = 8  # paths of up to so many features are looked up, longer ones computed


def leaf_arrays(ls: Sequence[Leaf]) -> list[tuple]:
    """Leaves grouped by path length into chunks of plain numpy arrays
    ``(values[L], features[L,m], lo[L,m], hi[L,m], z[L,m], missing[L,m], patterns)``.

    ``patterns[L, 2^m, m]`` holds a leaf's contributions for each of the 2^m ways in which a row
    can be in or out of its path's intervals (bit j: in the j-th), so a row costs a lookup per
    leaf; it is None for long paths, whose contributions are computed per row.
    """
    by_m: dict[int, list[Leaf]] = {}
    for lf in ls:
        if lf.features:
            by_m.setdefault(len(lf.features), []).append(lf)
    out = []
    for m, group in sorted(by_m.items()):
        group.sort(key=lambda lf: tuple(lf.features))                # neighbours add to the same features
        for k in range(0, len(group), LEAF_CHUNK):
            g = group[k:k + LEAF_CHUNK]
            values = np.array([lf.value for lf in g], dtype=float)
            # a branch without training rows would make its factor impossible to divide out
            z = np.maximum(np.array([lf.z for lf in g], dtype=float), 1e-12)
            patterns = None
            if m <= PATTERN_FEATURES:
                inside = ((np.arange(1 << m)[None, :] >> np.arange(m)[:, None]) & 1).astype(float)
                patterns = np.ascontiguousarray(path_contributions(
                    values, z, np.broadcast_to(inside, (len(g), m, 1 << m))).transpose(1, 2, 0))
            missing = np.array([lf.missing or [False] * m for lf in g], dtype=bool)
            out.append((values, np.array([lf.features for lf in g], dtype=np.int64), np.array([lf.lo for lf in g], dtype=float),
                        np.array([lf.hi for lf in g], dtype=float), z, missing, patterns))
    return out


def path_contributions(values: np.ndarray, z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """(m, leaves, rows) contributions of the features of paths of length m, for o (leaves, m, rows)
    telling which intervals a row is in."""
    n_leaves, m, n = o.shape
    w = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    # coefficients of prod_j (z_j + o_j t), per leaf and row
    c = np.zeros((m + 1, n_leaves, n))
    c[0] = 1.0
    for j in range(m):
        zj = z[:, j, None]
        c[1:j + 2] = c[1:j + 2] * zj + c[:j + 1] * o[:, j]
        c[0] *= zj
    out = np.empty((m, n_leaves, n))
    for i in range(m):
        # divide (z_i + o_i t) out again: from the top where o_i is 1, by z_i where it is 0
        zi, on = z[:, i, None], o[:, i] > 0
        high = np.zeros((n_leaves, n))
        total = np.zeros((n_leaves, n))
        for k in range(m - 1, -1, -1):
            high = c[k + 1] - zi * high if k < m - 1 else c[m]
            total += w[k] * np.where(on, high, c[k] / zi)
        out[i] = values[:, None] * (o[:, i] - zi) * total
    return out


def _shap_batch(X: np.ndarray, table: Sequence[tuple]) -> np.ndarray:
    """Rows are numbers, NaN where missing, or bins as 16-bit integers."""
    n, n_features = X.shape
    xt, bins = np.ascontiguousarray(X.T), X.dtype == np.int16   # features x rows: rows innermost
    phi = np.zeros((n_features, n))
    for values, cols, lo, hi, z, missing, patterns in table:
        m = cols.shape[1]
        xs = xt[cols]                                      # leaves x m x rows
        if bins:
            lo, hi = np.maximum(lo, -1).astype(np.int16), np.minimum(hi, MISSING - 1).astype(np.int16)
        inside = (xs > lo[:, :, None]) & (xs <= hi[:, :, None])
        if missing.any():
            inside |= (xs == MISSING if bins else np.isnan(xs)) & missing[:, :, None]
        if patterns is None:
            parts = path_contributions(values, z, inside.astype(float))
            for j in range(m):
                for f in np.unique(cols[:, j]):
                    phi[f] += parts[j][cols[:, j] == f].sum(axis=0)
            continue
        code = inside[:, 0].astype(np.uint8)               # PATTERN_FEATURES bits
        for j in range(1, m):
            code |= inside[:, j].view(np.uint8) << np.uint8(j)
        starts = np.flatnonzero(np.append(True, (cols[1:] != cols[:-1]).any(axis=1)))
        for first, end in zip(starts, np.append(starts[1:], len(cols))):
            total = patterns[first].take(code[first], axis=0)
            for i in range(first + 1, end):
                total += patterns[i].take(code[i], axis=0)
            phi[cols[first]] += total.T                    # a path has each feature once
    return phi.T


# ------------------------------------------------------------------------- tables of a whole tree
TABLE_CELLS = 1 << 16   # cells of a tree's tables
TABLE_ROWS = 1 << 17    # rows that are looked up together in the tables of one tree
LOOKUP_ROWS = 1 << 13   # rows that stay in the processor's cache


@dataclass
class TreeLeaves:
    """Leaves of a booster's tree over all features of the tree: (leaves, features) intervals of bins, shares of
    cover and whether missing values are inside."""

    values: np.ndarray
    features: list[int]
    lo: np.ndarray
    hi: np.ndarray
    z: np.ndarray
    missing: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + self.lo.nbytes + self.hi.nbytes + self.z.nbytes + self.missing.nbytes

    def cuts(self) -> list[np.ndarray]:
        return [np.setdiff1d(np.concatenate([lo, hi]), [-1, MISSING - 1]) for lo, hi in zip(self.lo.T, self.hi.T)]


def whole_tree(ls: Sequence[Leaf]) -> TreeLeaves | None:
    """None for a tree whose tables would be too large."""
    features = sorted({f for lf in ls for f in lf.features})
    place, shape = {f: j for j, f in enumerate(features)}, (len(ls), len(features))
    lo, hi = np.full(shape, -1, np.int16), np.full(shape, MISSING - 1, np.int16)
    z, missing = np.ones(shape), np.ones(shape, dtype=bool)
    for i, lf in enumerate(ls):
        for k, f in enumerate(lf.features):
            j = place[f]
            lo[i, j], hi[i, j], z[i, j], missing[i, j] = max(lf.lo[k], -1), min(lf.hi[k], MISSING - 1), lf.z[k], lf.missing[k]
    out = TreeLeaves(np.array([lf.value for lf in ls], dtype=float), features, lo, hi, z, missing)
    sizes = [len(c) + 2 for c in out.cuts()]
    fits = len(ls) <= MASK_LEAVES and sum(prod(sizes) // n for n in sizes) <= TABLE_CELLS
    return out if fits else None


class TreeTables:
    """Lookup tables of the contributions of one tree."""

    def __init__(self, tree: TreeLeaves):
        k, bins = len(tree.features), np.arange(256)
        codes, inside, bits = [], [], []
        leaf = np.left_shift(np.uint64(1), np.arange(len(tree.values), dtype=np.uint64))
        for j, cuts in enumerate(tree.cuts()):
            code = np.searchsorted(cuts, bins)
            code[MISSING] = len(cuts) + 1
            here = np.concatenate([cuts, [MISSING - 1, MISSING]])    # a bin of every interval, and the missing ones
            on = (here > tree.lo[:, j, None]) & (here <= tree.hi[:, j, None])
            on[:, -1] = tree.missing[:, j]
            codes.append(code)
            inside.append(on.astype(float))
            bits.append(np.bitwise_or.reduce(np.where(on, leaf[:, None], np.uint64(0)), axis=0)[code].view(np.int64))
        self.features, self.bits = tree.features, bits
        self.whole = np.zeros(1023 + MASK_LEAVES)
        self.whole[1023:1023 + len(tree.values)] = tree.values / k
        weight = [factorial(n) * factorial(k - n - 1) / factorial(k) for n in range(k)]
        self.tables = []
        for out in range(k):     # the table without this feature has the sets whose first absent one it is
            known = [j for j in range(k) if j != out]
            sizes = [inside[j].shape[1] for j in known]
            table = np.zeros((k, *sizes))
            for n in range(k - out):
                for more in combinations(range(out + 1, k), n):
                    s = [*range(out), *more]
                    part = tree.values * np.prod(tree.z[:, [j for j in range(k) if j not in s]], axis=1)
                    for j in s[:-1]:
                        part = (part[..., None] * inside[j].reshape(len(inside[j]), *[1] * (part.ndim - 1), -1))
                    v = np.tensordot(part, inside[s[-1]], axes=(0, 0)) if s else np.asarray(part.sum())
                    v = v.reshape([inside[j].shape[1] if j in s else 1 for j in known])
                    for i in range(k):
                        table[i] += v * (weight[len(s) - 1] if i in s else -weight[len(s)])
            steps = [prod(sizes[a + 1:]) for a in range(len(sizes))]
            places = [(j, codes[j] * step) for j, step in zip(known, steps)]
            self.tables.append((places, np.ascontiguousarray(np.moveaxis(table, 0, -1)).reshape(-1, k)))

    def add(self, phi: np.ndarray, columns: np.ndarray) -> None:
        """Add the contributions of rows with (all features, rows) bins, as indices, to (rows, all features) ``phi``."""
        own = [columns[f] for f in self.features]
        left = self.bits[0].take(own[0])
        for bits, column in zip(self.bits[1:], own[1:]):
            left &= bits.take(column)
        total = self.whole.take((left.astype(float).view(np.int64) >> 52) & 2047)[:, None]   # one leaf is left over
        for places, table in self.tables:
            at = np.zeros(columns.shape[1], dtype=np.int64) if not places else places[0][1].take(own[places[0][0]])
            for j, code in places[1:]:
                at += code.take(own[j])
            total = total + table.take(at, axis=0)
        if len(self.features) == phi.shape[1]:
            phi += total
        else:
            phi[:, self.features] += total


def shap_values(X: np.ndarray, ls: Sequence[Leaf]) -> np.ndarray:
    """Attribution matrix (rows x features) for a batch of rows."""
    return _shap_batch(X, leaf_arrays(ls))


# Leaf groups that a task keeps in memory; beyond it, it reads them again for every batch.
GROUP_BYTES, CACHE_BYTES = 16 << 20, 512 << 20


def _grouped(table: Sequence[tuple], limit: int) -> list[list[tuple]]:
    groups, size = [[]], 0
    for chunk in table:
        n = sum(a.nbytes for a in chunk if a is not None)
        if groups[-1] and size + n > limit:
            groups.append([])
            size = 0
        groups[-1].append(chunk)
        size += n
    return groups


def _put_groups(spark, table: Sequence[tuple], limit: int) -> list[tuple[str, int]]:
    """Write the leaf table to the shared folder in groups; (path, bytes) of each."""
    folder, out = shared_path(spark, "attribution"), []
    for i, group in enumerate(_grouped(table, limit)):
        data = pickle.dumps(group)
        store, path = file_system(f"{folder}/group-{i:05d}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(data)
        out.append((f"{folder}/group-{i:05d}", len(data)))
    return out


def attribute(model, df: DataFrame, id_col: str, features: Sequence[str],
              group_bytes: int = GROUP_BYTES, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Long table ``(id, feature, value, contribution, base)`` for every row of ``df``.

    ``model`` is a two-class :class:`~panelstats.operators.boosting.BoostedModel`, or a fitted
    pipeline whose last stage is a ``GBTClassificationModel``; ``value`` is the feature value the
    trees saw (NULL where a booster saw a missing one, the imputed one in a pipeline).  A pipeline
    fitted with missing indicators is explained over all its inputs; an indicator's share is
    added to its feature's, so base + contributions is the log-odds either way.

    The leaf table lies in the shared folder; tasks read it group by group and add up, so
    its size is bounded by nothing but the model.
    """
    spark = df.sparkSession
    ship_package(spark)
    features = list(features)
    if isinstance(model, BoostedModel):
        folder, base = boosted_leaf_table(model, spark, group_bytes)
        inputs = [f"__f{i}" for i in range(len(model.features))]
        first = [model.features.index(f) for f in features]
        owners = [features.index(f) for f in model.features]
        src = spread_rows(df.select(F.col(f"`{id_col}`").alias(id_col), *numbers(model.features)))
        groups = [(f, folder.bytes) for f in folder.files]
    else:
        prep = PipelineModel(stages=model.stages[:-1]).transform(df)
        inputs = list(model.stages[-2].getInputCols())
        owner = {prepared(f): i for i, f in enumerate(features)} | {f"{f}_missing": i for i, f in enumerate(features)}
        owners = [owner[c] for c in inputs]
        first = [inputs.index(prepared(f)) for f in features]
        src = spread_rows(prep.select(id_col, *inputs))
        ls = gbt_leaves(spark, model.stages[-1])
        base = expected_value(ls)
        groups = _put_groups(spark, leaf_arrays(ls), group_bytes)
    keep = sum(n for _, n in groups) <= cache_bytes
    id_type = df.schema[id_col].dataType.simpleString()

    schema = f"`{id_col}` {id_type}, feature string, value double, contribution double, base double"
    if isinstance(model, BoostedModel):
        return src.mapInArrow(_booster_rows(model.cuts, [p for p, _ in groups], keep, id_col, features, first, owners, base), schema)

    def run(batches):
        group = _groups(keep)
        names = np.asarray(features, dtype=object)
        k = len(features)
        for pdf in batches:
            if pdf.empty:
                continue
            raw = pdf[inputs].to_numpy(dtype=float)
            phi = np.zeros((len(raw), k))
            for path, _ in groups:
                part = _shap_batch(raw, group(path))
                for col, own in enumerate(owners):
                    phi[:, own] += part[:, col]
            yield pd.DataFrame({
                id_col: np.repeat(pdf[id_col].to_numpy(), k),
                "feature": np.tile(names, len(pdf)),
                "value": raw[:, first].reshape(-1),
                "contribution": phi.reshape(-1),
                "base": np.full(len(pdf) * k, base),
            })

    return src.mapInPandas(run, schema)


def _groups(keep: bool):
    """Reads a group of the leaf table, once a task if all of them may be kept."""
    held: dict = {}

    def group(path):
        if path in held:
            return held[path]
        data = [chunk for part in _read_group(path) for chunk in part]
        if keep:
            held[path] = data
        return data

    return group


def _booster_rows(cuts, paths: Sequence[str], keep: bool, id_col: str, features: Sequence[str], first, owners, base: float):
    """The long rows of a booster's attribution: many rows are looked up in the tables of one tree after another."""
    inputs, k = [f"__f{i}" for i in range(len(cuts))], len(features)

    def run(batches):
        group, names = _groups(keep), pa.array(list(features), pa.string())
        for batch in _chunks(batches, TABLE_ROWS):
            raw = _matrix(batch, inputs)
            bins = binned(raw, cuts)
            found = np.zeros(bins.shape)
            parts = [slice(a, a + LOOKUP_ROWS) for a in range(0, len(bins), LOOKUP_ROWS)]
            columns = [np.ascontiguousarray(bins[part].T).astype(np.intp) for part in parts]
            for path in paths:
                chunks = []
                for item in group(path):
                    if not isinstance(item, TreeLeaves):
                        chunks.append(item)
                        continue
                    tables = TreeTables(item)
                    for part, own in zip(parts, columns):
                        tables.add(found[part], own)
                if chunks:
                    for part in parts:
                        found[part] += _shap_batch(bins[part].astype(np.int16), chunks)
            phi = np.zeros((len(bins), k))
            for col, own in enumerate(owners):
                phi[:, own] += found[:, col]
            for part in parts:
                n = len(raw[part])
                value = raw[part][:, first].ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col)[part].take(pa.array(np.repeat(np.arange(n), k))), names.take(pa.array(np.tile(np.arange(k), n))),
                     pa.array(value, mask=np.isnan(value)), pa.array(phi[part].ravel()), pa.array(np.full(n * k, base))],
                    [id_col, "feature", "value", "contribution", "base"])

    return run


def _read_group(uri: str) -> list[list[tuple]]:
    """The chunk lists of a group: a pickled file, or a Parquet file of pickled rows."""
    store, path = file_system(uri)
    if path.endswith(".parquet"):
        with store.open_input_file(path) as f:
            return [pickle.loads(b) for b in pq.read_table(f, columns=["payload"]).column("payload").to_pylist()]
    with store.open_input_stream(path) as f:
        return [pickle.loads(f.read())]


# -------------------------------------------------------------------------- boosters' leaf tables
def tree_leaves(pieces: dict) -> list[Leaf]:
    """Leaves of one tree of a booster, their intervals in bins (the split sends bins up to its
    bin to the left), and whether the path takes missing values at each feature."""
    out, stack = [], [("", 0, {})]
    while stack:
        path, i, seen = stack.pop()
        piece = pieces[path]
        left, right = int(piece["left"][i]), int(piece["right"][i])
        if left == -1:
            feats = sorted(seen)
            out.append(Leaf(0, i, float(piece["value"][i]), feats, *[[seen[f][k] for f in feats] for k in range(3)],
                            rows=int(piece["rows"][i]), missing=[seen[f][3] for f in feats]))
            continue
        f, cut, default = int(piece["feature"][i]), float(piece["bin"][i]), bool(piece["default_left"][i])
        covers = [float(piece["hess"][k]) for k in ((1, 2) if left == OPEN else (left, right))]
        lo, hi, z, missing = seen.get(f, (-np.inf, np.inf, 1.0, True))
        for go_left, cover, child in ((True, covers[0], left), (False, covers[1], right)):
            step = {**seen, f: (lo if go_left else max(lo, cut), min(hi, cut) if go_left else hi,
                                z * cover / float(piece["hess"][i]), missing and go_left == default)}
            stack.append((path + "LR"[not go_left], 0, step) if left == OPEN else (path, child, step))
    return out


@dataclass
class _Folder:
    files: list[str]
    bytes: int


def boosted_leaf_table(model: BoostedModel, spark, group_bytes: int = GROUP_BYTES) -> tuple[_Folder, float]:
    """Leaf tables of all trees of a two-class booster, built by tasks from the trees' pieces and
    written in groups to the shared folder; and the model's expected log-odds."""
    def run(batches):
        state: dict = {"tree": None, "pieces": {}, "trees": [], "leaves": [], "expected": 0.0, "n": 0}

        def flush():
            table, expected = [*state["trees"], *leaf_arrays(state["leaves"])], state["expected"]
            state.update(trees=[], leaves=[], expected=0.0, n=0)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(table)], pa.binary()), pa.array([expected])], ["payload", "expected"])

        def close():
            found = tree_leaves(state["pieces"])
            state["expected"] += expected_value(found)
            if not any(lf.features for lf in found):
                return
            whole = whole_tree(found)
            if whole:
                state["trees"].append(whole)
                state["n"] += whole.nbytes
                return
            state["leaves"] += found
            state["n"] += sum((16 << min(len(lf.features), PATTERN_FEATURES)) * max(1, len(lf.features)) for lf in found)

        for batch in batches:
            columns = {n: batch.column(n) for n in ("round", "tree", "path")}
            for i, key in enumerate(zip(columns["round"].to_pylist(), columns["tree"].to_pylist())):
                if key != state["tree"]:
                    if state["tree"] is not None:
                        close()
                        if state["n"] > group_bytes:
                            yield flush()
                    state["tree"], state["pieces"] = key, {}
                state["pieces"][columns["path"][i].as_py()] = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in FIELDS}
        if state["tree"] is not None:
            close()
            yield flush()

    trees = model.pieces(spark).repartition(spark.sparkContext.defaultParallelism, "round").sortWithinPartitions("round", "tree")
    path = shared_path(spark, "attribution")
    trees.mapInArrow(run, "payload binary, expected double").write.parquet(path)
    table = spark.read.parquet(path)
    about = table.agg(F.sum(F.octet_length("payload")).alias("bytes"), F.sum("expected").alias("expected")).first()
    files = sorted(table.inputFiles())
    return _Folder(files, (about["bytes"] or 0) // max(1, len(files))), model.base + (about["expected"] or 0.0)
