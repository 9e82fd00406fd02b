"""Gradient-boosted trees on histograms, many models at once.

Second-order boosting: leaf value ``-T(G) / (H + lambda)`` and split gain
``T(G_l)^2 / (H_l + lambda) + T(G_r)^2 / (H_r + lambda) - T(G)^2 / (H + lambda)``, where ``T`` is soft
thresholding by alpha and G, H are the sums of the loss's first and second derivatives; the
logistic loss for two classes, softmax for more (one tree per class and round, which share the
gradients of one softmax).  Missing values have a bin of their own, and every split learns the
side they go to.

All models of a job - candidates of a search x folds x classes - grow together.  Features are
binned once.  Rows that the tasks of one stage can hold are trained on in barrier stages of many rounds:
each task keeps its share, and level by level the tasks hand each other the histograms of their rows
(every task adds and splits its share of the nodes) and at last the rows of small nodes, as files of the
shared folder.  Trees of a round grow in batches of bounded rows, and models whose margins the tasks cannot hold
together train one group after another.  Tables of which they cannot hold one model's, and clusters whose executors
come and go, have a Spark job
per round and level, which runs over the rows: every map task emits, for every
open node of every tree, one histogram of its rows (model, node, feature, bin);
histograms of a node are added after the shuffle and split there.  Nodes of at most
``finish_rows`` rows (a parameter, so a bounded group) wait for the last job of the round, send
their rows and are grown to their end by one task each, by the same gains: the number of jobs per
round follows the logarithm of the rows, not the depth.  Both ways give the same tree.

Derivatives are rounded to multiples of 2^-24, so their sums are exact and trees do not depend on
how rows are dealt to tasks.  Margins of all rows are a table in the shared folder, rewritten every
few rounds (the one before is deleted); trees are Parquet rows that tasks read from there.  The
driver sees counts and, while a round lasts, the splits of nodes beyond ``finish_rows``, which it
stores; never rows or finished nodes.
"""

from __future__ import annotations

import json
import math
import pickle
import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstats.session import file_system, shared_path, ship_package, task_slots

MISSING = 255               # bin of missing values; others are 0..254
FINISH_ROWS = 1 << 20       # rows of a node that one task may finish (12 MB at four features)
ROW_TREES = 20_000          # rows x trees that are worth a task
CELLS_PER_ROW = 4           # histogram cells a row beyond which a finished node's rows are sorted instead
CHUNK_ROWS = 1 << 18        # rows that a task handles at once, and the values of their margins
CHUNK_VALUES = 1 << 22
SEND_ROWS, SEND_BYTES = 1 << 16, 8 << 20   # rows of one payload, bytes of payloads sent at once
CACHE_CELLS = 1 << 14       # histogram cells whose splits are weighed together
NODES, SORTED_NODES = 512, 256   # nodes split together by histograms, and by sorted rows (a node and a bin are 16 bits)
BATCH_ROWS = 3_000_000      # rows x trees of a task that grow together, about 100 bytes each
CHUNK_STEPS = 1 << 14       # rows that walk down a tree together
COUNT_ROWS = 1 << 18        # rows x trees of a task up to which histograms with counts cost less than another step
MASK_LEAVES = 64            # leaves of a tree that a row finds by one bit each
HISTOGRAM_BYTES = 64 << 20  # histograms that a task holds before it sends them
FEW_BYTES, FEW_NODES = 1 << 20, 16  # rows of a node that are worth no histograms, nodes that every task may split
FEW_ROWS = 1 << 14          # rows of a node that are not worth another level to share the work more evenly
ROUNDS = 250                # rounds of one barrier stage; a lost executor costs at most these
HELD_BYTES = 600 << 20      # rows and margins that a task of a barrier stage may hold
WALK = 2_000_000            # margins are rewritten every sqrt(WALK / (rows x trees a core)) rounds
QUANTUM = float(1 << 24)
TINY = 1e-6                 # gains up to it do not split

PIECE_SCHEMA = ("round int, tree int, path string, feature array<int>, bin array<int>, default_left array<boolean>, "
                "left array<int>, right array<int>, value array<double>, hess array<double>, rows array<bigint>, gain array<double>")
_PIECE = pa.schema([("round", pa.int32()), ("tree", pa.int32()), ("path", pa.string()), ("feature", pa.list_(pa.int32())),
                    ("bin", pa.list_(pa.int32())), ("default_left", pa.list_(pa.bool_())), ("left", pa.list_(pa.int32())),
                    ("right", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("hess", pa.list_(pa.float64())),
                    ("rows", pa.list_(pa.int64())), ("gain", pa.list_(pa.float64()))])
OPEN = -2                   # left child of a piece whose children are pieces of their own


@dataclass(frozen=True)
class Params:
    """Parameters of one booster, in the source's names and with its library's defaults."""

    n_estimators: int = 500
    max_depth: int = 6
    learning_rate: float = 0.3
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    colsample_bytree: float = 1.0
    subsample: float = 1.0
    scale_pos_weight: float = 1.0
    seed: int = 0

    @classmethod
    def of(cls, drawn: Mapping[str, float], **more) -> "Params":
        """From drawn or listed values; ``nrounds`` and ``eta`` are the other library's names."""
        names = {"nrounds": "n_estimators", "eta": "learning_rate"}
        values = {names.get(k, k): v for k, v in drawn.items()}
        values = {k: int(v) if k in ("n_estimators", "max_depth", "seed") else float(v) for k, v in values.items()}
        return cls(**{**values, **more})


def soft(g, alpha: float):
    """Soft thresholding of a gradient sum by the L1 term."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g, h, p: Params):
    """Newton step of a leaf, shrunk by the learning rate."""
    return -p.learning_rate * soft(g, p.reg_alpha) / np.maximum(h + p.reg_lambda, 1e-16)


def _score(g, h, p: Params):
    return soft(g, p.reg_alpha) ** 2 / np.maximum(h + p.reg_lambda, 1e-16)


def _split_gain(gl, hl, nl, g, h, n, p: Params):
    """Gain of splits with the given left sums; minus infinity where a side is too light."""
    gr, hr, nr = g - gl, h - hl, n - nl
    gain = _score(gl, hl, p) + _score(gr, hr, p) - _score(g, h, p)
    fits = (nl > 0) & (nr > 0) & (hl >= p.min_child_weight) & (hr >= p.min_child_weight)
    return np.where(fits, gain, -np.inf)


@dataclass
class Splits:
    """Best split of each of several nodes (gain minus infinity where there is none)."""

    gain: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    default_left: np.ndarray
    gl: np.ndarray
    hl: np.ndarray
    nl: np.ndarray

    @classmethod
    def none(cls, n: int) -> "Splits":
        z = np.zeros(n)
        return cls(np.full(n, -np.inf), z.astype(int), z.astype(int), z.astype(bool), z.copy(), z.copy(), z.copy())

    def take(self, better: np.ndarray, **values) -> None:
        for name, v in values.items():
            old = getattr(self, name)
            old[better] = v[better] if isinstance(v, np.ndarray) else v


def _offer(best: Splits, feature: int, bins, gl, hl, nl, gm, hm, nm, tot, first, p: Params) -> None:
    """Offer the candidate splits of one feature: ``first`` gives each node's first candidate,
    the left sums leave the missing rows out; ties stay with the earlier candidate, and missing
    values go to the heavier side where there are none to learn from."""
    if not len(bins):
        return
    counts = np.diff(np.append(first, len(bins)))
    has = counts > 0
    owner = np.repeat(np.arange(len(first)), counts)
    g, h, n = (t[owner] for t in tot)
    for with_left in (False, True):
        if with_left:
            left = (gl + gm[owner], hl + hm[owner], nl + nm[owner])
            gain = np.where(nm[owner] > 0, _split_gain(*left, g, h, n, p), -np.inf)
        else:
            left = (gl, hl, nl)
            gain = _split_gain(*left, g, h, n, p)
        top = np.full(len(first), -np.inf)
        top[has] = np.maximum.reduceat(gain, first[has])
        hit = np.flatnonzero((gain == top[owner]) & np.isfinite(gain))
        place = np.full(len(first), -1)
        place[owner[hit][::-1]] = hit[::-1]
        better = (place >= 0) & (top > best.gain)
        at = np.maximum(place, 0)
        side = np.where(nm > 0, with_left, 2 * left[1][at] >= tot[1])
        best.take(better, gain=top, feature=feature, bin=bins[at], default_left=side, gl=left[0][at], hl=left[1][at], nl=left[2][at])


def best_from_histogram(hist: np.ndarray, allowed: np.ndarray, p: Params) -> tuple[Splits, np.ndarray]:
    """Best split of one node from its (3, features, 256) sums of derivatives and rows."""
    best, tot = best_from_histograms(hist[:, None], allowed, p)
    return best, tot[:, 0]


def best_from_histograms(hist: np.ndarray, allowed: np.ndarray, p: Params) -> tuple[Splits, np.ndarray]:
    """Best split of each node from their (3, nodes, features, 256) sums, all features at once; ties as
    in ``_offer``.  As many nodes are looked at together as stay in the processor's cache."""
    features = np.flatnonzero(allowed)
    n, step = hist.shape[1], max(1, CACHE_CELLS // (len(features) << 8))
    best, tot = Splits.none(n), np.zeros((3, n))
    for a in range(0, n, step):
        part = hist[:, a:a + step]
        _best_cells(best, tot, a, part if len(features) == hist.shape[2] else part[:, :, features], features, p)
    return best, tot


def _scores(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    """``_score`` of many cells, by fewer steps where the L1 term is zero or the L2 term is not."""
    if p.reg_alpha == 0:
        g = g * g
    else:                                                            # the square of ``soft``, which needs no sign
        g = np.maximum(np.abs(g) - p.reg_alpha, 0.0)
        g *= g
    h = h + p.reg_lambda
    return np.divide(g, h if p.reg_lambda >= 1e-16 else np.maximum(h, 1e-16), out=g)


def _best_cells(best: Splits, tot: np.ndarray, at: int, hist: np.ndarray, features: np.ndarray, p: Params) -> None:
    """Nodes ``at`` and on: their sums into ``tot``, their best splits into ``best``."""
    n, k = hist.shape[1:3]
    here = np.arange(n)
    left, missing = np.cumsum(hist[:, :, :, :MISSING], axis=3), hist[:, :, :, MISSING:]
    total = tot[:, at:at + n] = left[:, :, 0, -1] + missing[:, :, 0, 0]
    none = hist[2, :, :, :MISSING] == 0                              # no row has the bin, so it is no cut
    g, h, rows = total[:, :, None, None]
    before = _scores(g, h, p)
    sides = 1 + bool(missing[2].any())                               # missing values may go either way
    gains = np.empty((n, k, sides, MISSING))
    for side in range(sides):
        gl, hl, nl = left + missing if side else left
        hr = h - hl
        gain = np.add(_scores(gl, hl, p), _scores(g - gl, hr, p), out=gains[:, :, side])
        gain -= before
        bad = none | (np.minimum(hl, hr) < p.min_child_weight)
        if p.min_child_weight <= 0:                                  # else a side without rows is too light
            bad |= nl >= rows
        if side:
            bad |= missing[2] == 0
        np.copyto(gain, -np.inf, where=bad)
    top = gains.reshape(n, -1).argmax(axis=1)
    feature, side, cell = np.unravel_index(top, gains.shape[1:])
    gain, gone = gains[here, feature, side, cell], missing[:, here, feature, 0]
    sums = left[:, here, feature, cell] + np.where(side, gone, 0.0)
    found = np.flatnonzero(np.isfinite(gain))
    values = {"gain": gain, "feature": features[feature], "bin": cell, "gl": sums[0], "hl": sums[1], "nl": sums[2],
              "default_left": np.where(gone[2] > 0, side == 1, 2 * sums[1] >= total[1])}
    for name, v in values.items():
        getattr(best, name)[at + found] = v[found]


def hist_bytes(n_nodes: int, n_features: int) -> int:
    """Bytes of the histograms of some nodes."""
    return 24 * 256 * n_nodes * n_features


def cell_sums(column: np.ndarray, g, h, node: np.ndarray, n_nodes: int) -> np.ndarray:
    """(3, nodes, 256) sums of the derivatives and the rows of every bin of one feature."""
    cell = (node << 8) + column if n_nodes > 1 else column.astype(np.intp)
    n = n_nodes << 8
    return np.array([np.bincount(cell, g, n), np.bincount(cell, h, n), np.bincount(cell, minlength=n)]).reshape(3, n_nodes, 256)


def _best_by_features(columns, g, h, node, n_nodes: int, allowed, p: Params) -> Splits:
    """Best splits of nodes whose rows are at hand, by the histograms of one feature at a time."""
    best = Splits.none(n_nodes)
    for f in np.flatnonzero(allowed):
        one, _ = best_from_histograms(cell_sums(columns[f], g, h, node, n_nodes)[:, :, None], np.ones(1, dtype=bool), p)
        best.take(one.gain > best.gain, **(vars(one) | {"feature": f}))
    return best


def _cells(columns, g, h, node, n_nodes: int, allowed) -> np.ndarray:
    """(3, nodes, features, 256) sums of the same nodes."""
    hist = np.zeros((3, n_nodes, len(columns), 256))
    for f in np.flatnonzero(allowed):
        hist[:, :, f] = cell_sums(columns[f], g, h, node, n_nodes)
    return hist


def _cells_of_pairs(above: np.ndarray, columns, g, h, node, rows: np.ndarray, allowed) -> np.ndarray:
    """The same for nodes that are pairs of children, by their parents' sums: only the rows of the smaller
    child of each pair are added up, the other child has the rest (sums are exact)."""
    pairs = len(rows) // 2
    right = rows[1::2] < rows[::2]                                   # the smaller child is the right one
    on = np.flatnonzero((node & 1) == right.take(node >> 1))
    part = _cells([c[on] for c in columns], g[on], h[on], node[on] >> 1, pairs, allowed)
    hist = np.empty((3, pairs, 2, *part.shape[2:]))
    here, right = np.arange(pairs), right.astype(int)
    hist[:, here, right] = part
    hist[:, here, 1 - right] = above - part
    return hist.reshape(3, 2 * pairs, *part.shape[2:])


# Where a side without rows is too light, a bin without rows is as good as the one before it (or, before all others,
# with missing values on its left, as the last one with them on its right), so the splits need no counts: the sums
# of both derivatives are one array of complex numbers.
def pair_sums(columns, c: np.ndarray, node: np.ndarray, n_nodes: int, features) -> np.ndarray:
    """(features, nodes, 256) sums of the derivatives, the second ones as imaginary parts."""
    out, base = np.zeros((len(features), n_nodes << 8), dtype=complex), node << 8 if n_nodes > 1 else 0
    for sums, f in zip(out, features):
        np.add.at(sums, np.add(base, columns[f], dtype=np.intp), c)
    return out.reshape(len(features), n_nodes, 256)


def _pair_gains(gl: np.ndarray, hl: np.ndarray, total: np.ndarray, p: Params) -> np.ndarray:
    """Gains of splits with the given left sums of nodes with the given sums (of a shape to go with them)."""
    g, h = np.ascontiguousarray(total.real), np.ascontiguousarray(total.imag)
    hr = h - hl
    gain = _scores(gl, hl, p)
    gain += _scores(g - gl, hr, p)
    gain -= _scores(g, h, p)
    np.copyto(gain, -np.inf, where=np.minimum(hl, hr, out=hr) < p.min_child_weight)
    return gain


def best_of_sums(hist: np.ndarray, total: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Gain, place of the feature, bin, left sums and side of missing values (true: left) of the best split of each
    node, from their (features, nodes, 256) sums; ties as in ``_offer``."""
    k, n = hist.shape[:2]
    gain, sums = np.empty(n), np.empty(n, dtype=complex)
    place, sides = np.empty((3, n), dtype=int), 1 + bool(hist[:, :, MISSING].any())
    for a in range(0, n, step := max(1, CACHE_CELLS // (k << 8))):
        part, whole = hist[:, a:a + step], total[a:a + step, None]
        gl, hl = np.cumsum(part[:, :, :MISSING].real, axis=2), np.cumsum(part[:, :, :MISSING].imag, axis=2)
        gains = np.empty((gl.shape[1], k, sides, MISSING))
        gains[:, :, 0] = _pair_gains(gl, hl, whole, p).transpose(1, 0, 2)
        if sides > 1:
            gains[:, :, 1] = _pair_gains(gl + part[:, :, MISSING:].real, hl + part[:, :, MISSING:].imag, whole, p).transpose(1, 0, 2)
        flat, here, to = gains.reshape(len(gains), -1), np.arange(len(gains)), slice(a, a + len(gains))
        top = flat.argmax(axis=1)
        place[:, to] = f, side, cell = np.unravel_index(top, gains.shape[1:])
        gain[to], sums.real[to], sums.imag[to] = flat[here, top], gl[f, here, cell], hl[f, here, cell]
        sums[to] += part[f, here, MISSING] * side
    return gain, place[0], place[2], sums, place[1] == 1


def best_of_sorted(columns: np.ndarray, c: np.ndarray, node: np.ndarray, total: np.ndarray, rows: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """The same for at most ``SORTED_NODES`` small nodes, none of them empty, by their sorted rows."""
    key = (node.astype(np.uint16) << np.uint16(8)) | columns
    order = np.argsort(key, axis=1, kind="stable")                   # 16 bits are sorted by radix
    key = np.take_along_axis(key, order, axis=1)
    at, start = np.repeat(np.arange(len(rows)), rows), np.cumsum(rows) - rows
    part, before = c.take(order), np.cumsum(total) - total
    gl, hl = np.cumsum(part.real, axis=1), np.cumsum(part.imag, axis=1)
    gl -= before.real.take(at)
    hl -= before.imag.take(at)
    whole, here = total.take(at), np.arange(len(rows))
    no, gone = np.zeros(key.shape, dtype=bool), (key & 255) == MISSING
    no[:, :-1] = key[:, 1:] == key[:, :-1]
    left, missing = [(gl, hl)], None
    if gone.any():
        no |= gone
        missing = np.add.reduceat(np.where(gone, part, 0), start, axis=1)
        left.append((gl + missing.real.take(at, axis=1), hl + missing.imag.take(at, axis=1)))
    gains, tops = [], []
    for g, h in left:
        gains.append(_pair_gains(g, h, whole, p))
        np.copyto(gains[-1], -np.inf, where=no)
        tops.append(np.maximum.reduceat(gains[-1], start, axis=1))
    feature, side = np.divmod(np.stack(tops, axis=1).reshape(-1, len(rows)).argmax(axis=0), len(tops))
    top, place = np.choose(side, [t[feature, here] for t in tops]), np.zeros(len(rows), dtype=int)
    for i, (gain, best) in enumerate(zip(gains, tops)):
        hit = np.flatnonzero(gain.ravel() == np.repeat(best, rows, axis=1).ravel())
        k = np.flatnonzero(side == i)
        place[k] = hit[np.searchsorted(hit, (feature * key.shape[1] + start)[k])]
    sums = np.empty(len(rows), dtype=complex)
    sums.real, sums.imag = gl.ravel()[place], hl.ravel()[place]
    if missing is not None:
        sums += missing[feature, here] * side
    return top, feature, (key.ravel()[place] & 255).astype(int), sums, side == 1


def _best_from_rows(bins, g, h, node, n_nodes: int, order, allowed, p: Params) -> tuple[Splits, np.ndarray]:
    """The same for many small nodes; ``order`` sorts the rows by each feature."""
    tot = np.array([np.bincount(node, w, n_nodes) for w in (g, h, np.ones(len(g)))])
    best = Splits.none(n_nodes)
    size = tot[2].astype(int)
    node = node.astype(np.uint16 if n_nodes <= 1 << 16 else np.int64)  # short integers are sorted by radix
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    for f in np.flatnonzero(allowed):
        o = order[f][np.argsort(node[order[f]], kind="stable")]
        b, nd = bins[o, f], node[o]
        sums = np.cumsum([g[o], h[o], np.ones(len(o))], axis=1)
        base = np.where(start > 0, sums[:, np.maximum(start - 1, 0)], 0.0)
        gone = b == MISSING
        gm, hm, nm = (np.bincount(nd[gone], w[o][gone], n_nodes) for w in (g, h, np.ones(len(g))))
        last = np.ones(len(o), dtype=bool)
        last[:-1] = (b[1:] != b[:-1]) | (nd[1:] != nd[:-1])
        at = np.flatnonzero(last & ~gone)
        first = np.searchsorted(nd[at], np.arange(n_nodes))
        gl, hl, nl = sums[:, at] - base[:, nd[at]]
        _offer(best, f, b[at].astype(int), gl, hl, nl, gm, hm, nm, tot, first, p)
    return best, tot


def goes_left(bins: np.ndarray, split_bin, default_left) -> np.ndarray:
    return np.where(bins == MISSING, default_left, bins <= split_bin)


def side_of_bins(split_bin: np.ndarray, default_left: np.ndarray) -> np.ndarray:
    """(nodes, 256) whether each node sends each bin to the left, for lookups by (node << 8) + bin."""
    out = np.arange(256)[None, :] <= split_bin[:, None]
    out[:, MISSING] = default_left
    return out


FIELDS = ("feature", "bin", "default_left", "left", "right", "value", "hess", "rows", "gain")


def _leaves(tot: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """Nodes with the given (3, nodes) sums, none of them split yet."""
    n = tot.shape[1]
    return {"feature": np.full(n, -1), "bin": np.full(n, -1), "default_left": np.zeros(n, dtype=bool), "left": np.full(n, -1),
            "right": np.full(n, -1), "value": leaf_value(tot[0], tot[1], p), "hess": tot[1].copy(), "rows": tot[2].astype(np.int64),
            "gain": np.zeros(n)}


def _children(best: Splits, tot: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(3, 2 x splits) sums of the children of nodes ``k``, left and right in turn."""
    left = np.array([best.gl[k], best.hl[k], best.nl[k]])
    return np.stack([left, tot[:, k] - left], axis=2).reshape(3, -1)


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, allowed: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """A node's rows grown to their end, ``depth`` levels at most: the arrays of a piece."""
    c = np.empty(len(g), dtype=complex)
    c.real, c.imag = g, h
    return grown(np.ascontiguousarray(bins.T), c, depth, allowed, p)[0]


def grown(columns: np.ndarray, c: np.ndarray, depth: int, allowed: np.ndarray, p: Params) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A node's rows grown to their end, and the leaf of every row.  Nodes are split by histograms, or by sorted
    rows where they are so small that histograms would have more cells than the rows are worth; groups of nodes
    are taken to their end one after another, so what is held at once is bounded by the rows.  Rows leave with
    their leaf: a node with less than twice the least weight of a child is one."""
    if depth > 0 and len(c) and p.min_child_weight <= 0:
        piece = _grow_counted(columns, np.ascontiguousarray(c.real), np.ascontiguousarray(c.imag), depth, allowed, p)
        return piece, _step_down(piece, columns).astype(np.int32)
    features, least = np.flatnonzero(allowed), max(TINY, p.gamma)
    columns, total, leaf = columns[features], c.sum(keepdims=True), np.zeros(len(c), dtype=np.int32)
    missing = bool((columns == MISSING).any())
    blocks, count, todo = [_leaves(np.array([total.real, total.imag, [len(c)]]), p)], 1, []
    if depth > 0 and len(c) > 1 and total[0].imag >= 2 * p.min_child_weight:
        todo.append((blocks[0], np.zeros(1, dtype=int), np.zeros(1, dtype=int), total, columns, c, np.arange(len(c)),
                     np.zeros(len(c), dtype=np.int64), depth, None))
    while todo:
        block, place, name, total, columns, c, ids, node, depth, above = todo.pop()
        n = len(place)
        wide = n << 8 <= CELLS_PER_ROW * len(c)
        most = NODES if wide else SORTED_NODES
        if n > most:
            part = (node // most).astype(np.uint16 if n // most < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(-(-n // most) + 1))
            for i in range(len(ends) - 1):
                k, to = order[ends[i]:ends[i + 1]], slice(i * most, (i + 1) * most)
                todo.append((block, place[to], name[to], total[to], columns.take(k, axis=1), c.take(k), ids.take(k), node.take(k) - i * most, depth,
                             None if above is None else above[:, i * most // 2:(i + 1) * most // 2]))
            continue
        rows, hist = block["rows"][place], None
        if wide:
            every = range(len(features))
            if above is None or n << 8 > len(c):
                hist = pair_sums(columns, c, node, n, every)
            else:                    # only the smaller child of a pair is added up, the other has the rest
                right = rows[1::2] < rows[::2]
                on = np.flatnonzero((node & 1) == right.take(node >> 1))
                one = pair_sums(columns.take(on, axis=1), c.take(on), node.take(on) >> 1, n // 2, every)
                hist, here, right = np.empty((len(one), n // 2, 2, 256), dtype=complex), np.arange(n // 2), right.astype(int)
                hist[:, here, right], hist[:, here, 1 - right] = one, above - one
                hist = hist.reshape(len(one), n, 256)
            gain, feature, cut, left, side = best_of_sums(hist, total, p)
        else:
            gain, feature, cut, left, side = best_of_sorted(columns, c, node, total, rows, p)
        splits = gain > least
        k = np.flatnonzero(splits)
        if len(k) < n:
            on = splits.take(node)
            gone, on = np.flatnonzero(~on), np.flatnonzero(on)
            leaf[ids.take(gone)] = name.take(node.take(gone))
            if not len(k):
                continue
            columns, c, ids, node = columns.take(on, axis=1), c.take(on), ids.take(on), node.take(on)
        at, kids = place[k], 2 * np.arange(len(k))
        block["feature"][at], block["bin"][at], block["gain"][at] = features[feature[k]], cut[k], gain[k]
        block["left"][at], block["right"][at] = count + kids, count + kids + 1
        first = np.full(n, -1)
        first[k] = kids
        cell = columns.ravel().take((feature * len(c)).take(node) + np.arange(len(c)))
        right, to_left = cell > cut.take(node), 2 * left.imag >= total.imag   # without missing rows: the heavier side
        if missing and len(gone := np.flatnonzero(cell == MISSING)):
            known = np.bincount(node.take(gone), minlength=n) > 0
            to_left = np.where(known, side, to_left)
            right[gone] = ~side.take(node.take(gone))
        block["default_left"][at] = to_left[k]
        node = first.take(node) + right
        rows, total = np.bincount(node, minlength=2 * len(k)), np.stack([left[k], total[k] - left[k]], axis=1).ravel()
        blocks.append(_leaves(np.array([total.real, total.imag, rows]), p))
        name, count = count + np.arange(len(rows)), count + len(rows)
        goes = (rows > 1) & (total.imag >= 2 * p.min_child_weight) & (depth > 1)
        if hist is not None and len(rows) << 8 <= CELLS_PER_ROW * len(c):
            goes = goes.reshape(-1, 2).any(axis=1)                       # pairs stay together
            above, goes = hist[:, k[goes]], np.repeat(goes, 2)
        else:
            above = None
        if not goes.all():
            on = goes.take(node)
            gone, on = np.flatnonzero(~on), np.flatnonzero(on)
            leaf[ids.take(gone)] = name.take(node.take(gone))
            columns, c, ids, node = columns.take(on, axis=1), c.take(on), ids.take(on), (np.cumsum(goes) - 1).take(node.take(on))
        if len(c):
            place = np.flatnonzero(goes)
            todo.append((blocks[-1], place, name[place], total[place], columns, c, ids, node, depth - 1, above))
    return {name: np.concatenate([block[name] for block in blocks]) for name in FIELDS}, leaf


def _grow_counted(columns: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, allowed: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    """The same level by level, where sides may have no weight and splits need counts."""
    order = None
    node = np.zeros(len(g), dtype=np.int64)
    tot = np.array([[g.sum()], [h.sum()], [float(len(g))]])
    levels, count, above = [], 1, None
    while True:
        now = _leaves(tot, p)
        levels.append(now)
        if depth == 0 or not len(g):
            break
        n = tot.shape[1]
        hist = None
        if n << 8 <= CELLS_PER_ROW * len(g) and hist_bytes(n, len(columns)) > HISTOGRAM_BYTES:
            best = _best_by_features(columns, g, h, node, n, allowed, p)
        elif n << 8 <= CELLS_PER_ROW * len(g):
            hist = _cells(columns, g, h, node, n, allowed) if above is None or n << 8 > len(g) else _cells_of_pairs(
                above, columns, g, h, node, tot[2], allowed)
            best, _ = best_from_histograms(hist, allowed, p)
        else:
            order = order or [np.argsort(c, kind="stable") for c in columns]
            best, _ = _best_from_rows(columns.T, g, h, node, n, order, allowed, p)
        splits = best.gain > max(TINY, p.gamma)
        k = np.flatnonzero(splits)
        if not len(k):
            break
        above = None if hist is None else hist[:, k]
        for name in ("feature", "bin", "default_left", "gain"):
            now[name][k] = getattr(best, name)[k]
        kids = 2 * np.arange(len(k))
        now["left"][k], now["right"][k] = count + kids, count + kids + 1
        children = np.full(n, -1)
        children[k] = kids
        if len(k) < n:
            on = np.flatnonzero(splits[node])
            order = order and _compact(order, on, len(g))
            columns, g, h, node = columns[:, on], g[on], h[on], node[on]
        cell = columns.ravel().take(best.feature.take(node) * len(g) + np.arange(len(g)))
        left = side_of_bins(best.bin, best.default_left).ravel().take((node << 8) + cell)
        node = children.take(node) + ~left
        tot = _children(best, tot, k)
        count, depth = count + 2 * len(k), depth - 1
    return {name: np.concatenate([level[name] for level in levels]) for name in FIELDS}


def _compact(order: list[np.ndarray], rows: np.ndarray, n: int) -> list[np.ndarray]:
    """The feature orders restricted to ``rows``, as positions within them."""
    if len(rows) == n:
        return order
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    return [p[p >= 0] for p in (place[o] for o in order)]


# ------------------------------------------------------------------------------ trees in tasks
class Tree:
    """One tree from its pieces: a root piece, and pieces below the open nodes."""

    def __init__(self, pieces: Mapping[str, Mapping[str, np.ndarray]]):
        self.pieces, self.whole, self.masks = pieces, None, None

    def open_slots(self, bins: np.ndarray, slots: Mapping[str, int]) -> np.ndarray:
        """The slot of the (missing) piece that every row arrives at, -1 for pieces without one."""
        out = np.full(len(bins), -1)
        self._walk(bins, np.arange(len(bins)), "", lambda rows, path: out.__setitem__(rows, slots.get(path, -1)), lambda _: None)
        return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.of_columns(np.ascontiguousarray(bins.T))

    def of_columns(self, columns: np.ndarray) -> np.ndarray:
        """Values of the leaves that all rows arrive at, for (features, rows) bins."""
        if self.whole is None:
            self.whole = _joined(self.pieces)
            self.masks = _masks(self.whole) if (self.whole["left"] < 0).sum() <= MASK_LEAVES else None
        if self.masks is None:
            return self.whole["value"].take(_step_down(self.whole, columns))
        masks, values = self.masks
        left = np.full(columns.shape[1], -1)
        for f, mask in masks.items():
            left &= mask.take(columns[f])
        left &= -left                                        # the first leaf that no split takes away
        return values.take((left.astype(float).view(np.int64) >> 52) & 2047)

    def _walk(self, bins, rows, path, missing, found) -> None:
        if not len(rows):
            return
        piece = self.pieces.get(path)
        if piece is None:
            missing(rows, path)
        elif piece["left"][0] == OPEN:
            side = goes_left(bins[rows, piece["feature"][0]], piece["bin"][0], piece["default_left"][0])
            self._walk(bins, rows[side], path + "L", missing, found)
            self._walk(bins, rows[~side], path + "R", missing, found)
        else:
            found(rows)


def _joined(pieces: Mapping[str, Mapping[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The nodes of a whole tree in one piece, parents before their children."""
    parts, count, todo = [], 0, [("", None, "")]
    links = []
    while todo:
        path, parent, side = todo.pop()
        piece = pieces[path]
        n = 1 if piece["left"][0] == OPEN else len(piece["left"])
        part = {name: np.array(piece[name][:n]) for name in ("feature", "bin", "default_left", "left", "right", "value")}
        if parent is not None:
            links.append((parent, side, count))
        if piece["left"][0] == OPEN:
            todo += [(path + "R", count, "right"), (path + "L", count, "left")]
        else:
            for name in ("left", "right"):
                part[name] = np.where(part[name] < 0, part[name], part[name] + count)
        parts.append(part)
        count += n
    out = {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}
    for parent, side, child in links:
        out[side][parent] = child
    return out


def _masks(tree: Mapping[str, np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Per feature the leaves that each bin leaves over, as bits from the left to the right of the tree, where a
    split that sends a row to the right takes the leaves on its left away; and the leaves' values by the
    exponent of their bit."""
    left, right = tree["left"].tolist(), tree["right"].tolist()
    size, first = [1] * len(left), [0] * len(left)
    for i in reversed(range(len(left))):
        if left[i] >= 0:
            size[i] = size[left[i]] + size[right[i]]
    for i in range(len(left)):
        if left[i] >= 0:
            first[left[i]], first[right[i]] = first[i], first[i] + size[left[i]]
    values = np.zeros(1023 + MASK_LEAVES)
    leaves = np.flatnonzero(tree["left"] < 0)
    values[1023 + np.array(first)[leaves]] = tree["value"][leaves]
    inner = np.flatnonzero(tree["left"] >= 0)
    rest = np.array([~(((1 << size[left[i]]) - 1) << first[i]) for i in inner], dtype=np.int64)
    kept = np.where(side_of_bins(tree["bin"][inner], tree["default_left"][inner]), np.int64(-1), rest[:, None])
    return {int(f): np.bitwise_and.reduce(kept[tree["feature"][inner] == f], axis=0) for f in np.unique(tree["feature"][inner])}, values


def _step_down(tree: Mapping[str, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """The leaf of every row; all rows take a step together, and those that arrived stay behind."""
    n, flat, out = columns.shape[1], columns.ravel(), np.zeros(columns.shape[1], dtype=np.int64)
    missing, leaf, here = bool((columns == MISSING).any()), tree["left"] < 0, np.arange(len(tree["left"]))
    # a leaf is its own child, so rows that arrived may stay among the others
    children = np.stack([np.where(leaf, here, tree["right"]), np.where(leaf, here, tree["left"])], axis=1).ravel()
    offset, cut = np.where(leaf, 0, tree["feature"].astype(np.int64)) * n, tree["bin"].astype(np.int16)
    for a in range(0, n, CHUNK_STEPS):
        row = np.arange(a, min(n, a + CHUNK_STEPS))
        at = np.zeros(len(row), dtype=np.int64)
        while len(row):
            done = leaf.take(at)
            n_done = np.count_nonzero(done)
            if 4 * n_done > len(row):
                gone, on = np.flatnonzero(done), np.flatnonzero(~done)
                out[row.take(gone)] = at.take(gone)
                row, at = row.take(on), at.take(on)
            cell = flat.take(offset.take(at) + row)
            left = cell <= cut.take(at)
            if missing:
                left |= (cell == MISSING) & tree["default_left"].take(at)
            at = children.take(2 * at + left)
    return out


_READ: dict[str, dict] = {}  # pieces that a Python worker has read, newest last


def read_pieces(uri: str) -> dict[int, dict[int, dict]]:
    """Pieces of a folder by round, tree and path; a worker keeps the last few."""
    if uri not in _READ:
        store, path = file_system(uri)
        table = pads.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False).to_table()
        flat = {f.name: table.column(f.name).combine_chunks() for f in _PIECE}
        parts = {}
        for name in FIELDS:
            column = flat[name].combine_chunks() if isinstance(flat[name], pa.ChunkedArray) else flat[name]
            parts[name] = (np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False))
        found: dict[int, dict[int, dict]] = {}
        for i, (r, t, path_) in enumerate(zip(flat["round"].to_pylist(), flat["tree"].to_pylist(), flat["path"].to_pylist())):
            found.setdefault(r, {}).setdefault(t, {})[path_] = {n: v[o[i]:o[i + 1]] for n, (o, v) in parts.items()}
        while len(_READ) >= 16:
            _TREES.pop(next(iter(_READ)), None)
            _READ.pop(next(iter(_READ)))
        _READ[uri] = found
    return _READ[uri]


_TREES: dict[str, list[tuple[int, Tree]]] = {}  # the same as trees, in the order of rounds and outputs


def _trees(uri: str) -> list[tuple[int, Tree]]:
    pieces = read_pieces(uri)
    if uri not in _TREES:
        _TREES[uri] = [(t, Tree(nodes)) for _, trees in sorted(pieces.items()) for t, nodes in sorted(trees.items())]
    return _TREES[uri]


@dataclass(frozen=True)
class Plan:
    """What tasks need to know of a training job."""

    models: tuple[Params, ...]
    held: tuple[int, ...]        # fold that each model leaves out, -1 for none
    invert: bool                 # or the only fold it sees
    base: tuple[float, ...]      # starting margin of each model (logistic)
    outputs: int                 # trees per model and round: 1 for the logistic loss, else classes
    n_features: int
    finish_rows: int
    batch_rows: int = BATCH_ROWS
    count_rows: int = COUNT_ROWS
    counted: bool = False        # splits need counts, as sides may have no weight

    @property
    def trees(self) -> int:
        return len(self.models) * self.outputs

    def allowed(self, round_: int, tree: int) -> np.ndarray:
        """Features that a tree may use (all columns, or a seeded share of them)."""
        p = self.models[tree // self.outputs]
        out = np.ones(self.n_features, dtype=bool)
        k = max(1, int(p.colsample_bytree * self.n_features))
        if k < self.n_features:
            out[:] = False
            out[np.random.default_rng([p.seed, round_, tree % self.outputs]).permutation(self.n_features)[:k]] = True
        return out

    def drawn(self, row: np.ndarray, round_: int, model: int) -> np.ndarray:
        """Rows that a round uses, by a hash of their number."""
        p = self.models[model]
        if p.subsample >= 1.0:
            return np.ones(len(row), dtype=bool)
        x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((p.seed * 1_000_003 + round_) & 0xFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(11)).astype(float) * 2.0 ** -53) < p.subsample

    def kind(self, model: int) -> np.dtype:
        """Integers that hold a row's derivatives in units of the quantum."""
        return np.dtype(np.int32 if self.models[model].scale_pos_weight <= 100 else np.int64)

    def sees(self, fold: np.ndarray) -> np.ndarray:
        """(rows, models): whether a model trains on a row."""
        return (fold[:, None] == np.array(self.held)[None, :]) == self.invert

    def derivatives(self, margin: np.ndarray, label: np.ndarray, model: int) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, rows) first and second derivatives of the loss, rounded."""
        if self.outputs == 1:
            prob = 1.0 / (1.0 + np.exp(-np.clip(margin[:, 0], -700, 700)))
            w = np.where(label == 1, self.models[model].scale_pos_weight, 1.0)
            g, h = ((prob - label) * w)[None], np.maximum(prob * (1 - prob), 1e-16)[None] * w
        else:
            e = np.exp(margin - margin.max(axis=1, keepdims=True))
            prob = (e / e.sum(axis=1, keepdims=True)).T
            g = prob - (np.arange(self.outputs)[:, None] == label[None, :])
            h = np.maximum(2.0 * prob * (1 - prob), 1e-16)
        return np.rint(g * QUANTUM) / QUANTUM, np.rint(h * QUANTUM) / QUANTUM


def _fixed(column: pa.Array, kind, width: int) -> np.ndarray:
    """(rows, width) numbers of a binary column of equal lengths."""
    if not width or not len(column):
        return np.zeros((len(column), width), kind)
    size = np.dtype(kind).itemsize * width
    _, offsets, data = column.buffers()
    step = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(offsets, step)[column.offset])
    return np.frombuffer(data, np.uint8)[first:first + size * len(column)].view(kind).reshape(-1, width)


def _binaries(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.itemsize * matrix.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def _columns(batch: pa.RecordBatch, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    return _fixed(batch.column("bins"), np.uint8, plan.n_features), _fixed(batch.column("margin"), np.float64, plan.trees).copy()


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to about ``rows`` rows each; none is empty."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _chunk_rows(plan: Plan) -> int:
    return max(1, min(CHUNK_ROWS, CHUNK_VALUES // plan.trees))


def _advance(margin: np.ndarray, bins: np.ndarray, folders: Sequence[str]) -> None:
    """Add the trees of the folders to the margins of all rows, in their order."""
    columns = np.ascontiguousarray(bins.T)
    for uri in folders:
        for t, tree in _trees(uri):
            margin[:, t] += tree.of_columns(columns)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    t, path, whole, payload = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(path, pa.string()), pa.array(whole, pa.bool_()),
                                       pa.array(payload, pa.binary())], ["tree", "path", "whole", "payload"])


def _emit(plan: Plan, round_: int, done: Sequence[str], begun: Mapping[int, Mapping[str, dict]], opened: Mapping[int, Mapping[str, bool]]):
    """Rows (tree, path, whole, payload): histograms or rows of the open nodes, all of one kind in a
    tree.  A task adds up its rows' histograms and sends each once (or when they outgrow their room)."""
    slots = {t: {path: i for i, path in enumerate(nodes)} for t, nodes in opened.items()}
    paths = {t: list(nodes) for t, nodes in opened.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def histograms():
            for t, hist in sums.items():
                for i, path in enumerate(paths[t]):
                    if hist[2, i].any():
                        yield t, path, False, hist[:, i].tobytes()
            sums.clear()

        def rows():
            for batch in _chunks(batches, _chunk_rows(plan)):
                bins, margin = _columns(batch, plan)
                _advance(margin, bins, done)
                label, fold, row = (np.asarray(batch.column(c)) for c in ("label", "fold", "row"))
                seen, same = plan.sees(fold), {}
                for m in range(len(plan.models)):
                    mine = [t for t in range(m * plan.outputs, (m + 1) * plan.outputs) if t in opened]
                    if not mine:
                        continue
                    key = plan.held[m] if plan.models[m].subsample >= 1.0 else (m,)  # models that see the same rows
                    if key not in same:
                        used = np.flatnonzero(seen[:, m] & plan.drawn(row, round_, m))
                        same[key] = used, bins[used], np.ascontiguousarray(bins[used].T)
                    used, here, columns = same[key]
                    if not len(used):
                        continue
                    g, h = plan.derivatives(margin[used, m * plan.outputs:(m + 1) * plan.outputs], label[used], m)
                    for t in mine:
                        gt, ht = g[t - m * plan.outputs], h[t - m * plan.outputs]
                        at = Tree(begun.get(t, {})).open_slots(here, slots[t]) if begun.get(t) else np.zeros(len(used), dtype=np.int64)
                        if next(iter(opened[t].values())):
                            yield from whole_nodes(t, at, gt, ht, here, plan.kind(m))
                            continue
                        in_open = None if at.min() >= 0 else np.flatnonzero(at >= 0)
                        n, at, gt, ht = len(paths[t]), *(x if in_open is None else x[in_open] for x in (at, gt, ht))
                        if t not in sums:
                            sums[t] = np.zeros((3, n, plan.n_features, 256))
                        for f in np.flatnonzero(plan.allowed(round_, t)):
                            sums[t][:, :, f] += cell_sums(columns[f] if in_open is None else columns[f][in_open], gt, ht, at, n)
                if sum(x.nbytes for x in sums.values()) > HISTOGRAM_BYTES:
                    yield from histograms()
            yield from histograms()

        def whole_nodes(t, at, g, h, bins, kind):
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(paths[t]) + 1))
            for path, lo, hi in zip(paths[t], ends[:-1], ends[1:]):
                for a in range(lo, hi, SEND_ROWS):
                    k = order[a:min(hi, a + SEND_ROWS)]
                    yield t, path, True, (g[k] * QUANTUM).astype(kind).tobytes() + (h[k] * QUANTUM).astype(kind).tobytes() + bins[k].tobytes()

        out, size = [], 0
        for r in rows():
            out.append(r)
            size += len(r[3])
            if size >= SEND_BYTES:
                yield _sent(out)
                out, size = [], 0
        if out:
            yield _sent(out)

    return run


def _split_pair_sums(plan: Plan, round_: int, tree: int, path: str, hist: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """The piece of one node from its (features, 257) pair sums, the last of them the number of missing values; the
    rows of the children are to be filled in."""
    p = plan.models[tree // plan.outputs]
    features, depth = np.flatnonzero(plan.allowed(round_, tree)), p.max_depth - len(path)
    total = hist[features[0], :256].sum(keepdims=True)
    piece = _leaves(np.array([total.real, total.imag, [rows]]), p)
    if depth > 0:
        gain, feature, cell, left, side = best_of_sums(hist[features][:, None, :256], total, p)
        if gain[0] > max(TINY, p.gamma):
            both = np.concatenate([left, total - left])
            sides = _leaves(np.array([both.real, both.imag, [0, 0]]), p)
            piece = {name: np.concatenate([piece[name], sides[name]]) for name in FIELDS}
            piece["feature"][0], piece["bin"][0], piece["gain"][0] = features[feature[0]], cell[0], gain[0]
            piece["default_left"][0] = side[0] if hist[features[feature[0]], 256].real else 2 * left[0].imag >= total[0].imag
            piece["left"][0], piece["right"][0] = (1, 2) if depth == 1 else (OPEN, OPEN)
    return piece


def _split_node(plan: Plan, round_: int, tree: int, path: str, whole: bool, payloads: list[bytes]) -> dict[str, np.ndarray]:
    """The piece of one node from what all tasks sent of it."""
    model, n = tree // plan.outputs, plan.n_features
    p, kind = plan.models[model], plan.kind(model)
    allowed, depth = plan.allowed(round_, tree), p.max_depth - len(path)
    if whole:
        w = kind.itemsize
        sizes = [len(b) // (2 * w + n) for b in payloads]
        g = np.concatenate([np.frombuffer(b, kind, s) for b, s in zip(payloads, sizes)]) / QUANTUM
        h = np.concatenate([np.frombuffer(b, kind, s, w * s) for b, s in zip(payloads, sizes)]) / QUANTUM
        bins = np.concatenate([np.frombuffer(b, np.uint8, s * n, 2 * w * s).reshape(s, n) for b, s in zip(payloads, sizes)])
        return grow(bins, g, h, depth, allowed, p)
    best, tot = best_from_histogram(np.frombuffer(payloads[0]).reshape(3, n, 256), allowed, p)
    piece = _leaves(tot[:, None], p)
    if depth > 0 and best.gain[0] > max(TINY, p.gamma):
        # the children tell the driver their rows; they are leaves, or pieces of their own
        sides = _leaves(_children(best, tot[:, None], np.array([0])), p)
        piece = {name: np.concatenate([piece[name], sides[name]]) for name in FIELDS}
        for name in ("feature", "bin", "default_left", "gain"):
            piece[name][0] = getattr(best, name)[0]
        piece["left"][0], piece["right"][0] = (1, 2) if depth == 1 else (OPEN, OPEN)
    return piece


def _pieces_batch(round_: int, found: list[tuple[int, str, dict]]) -> pa.RecordBatch:
    lists = []
    for name in FIELDS:
        offsets = np.cumsum([0] + [len(piece[name]) for _, _, piece in found]).astype(np.int32)
        values = pa.array(np.concatenate([piece[name] for _, _, piece in found])).cast(_PIECE.field(name).type.value_type)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), values))
    return pa.RecordBatch.from_arrays([pa.array([round_] * len(found), pa.int32()), pa.array([t for t, _, _ in found], pa.int32()),
                                       pa.array([path for _, path, _ in found], pa.string()), *lists], schema=_PIECE)


def _reduce(plan: Plan, round_: int):
    """Sorted (tree, path, whole, payload) rows to one piece per node; the payloads of a node may
    go on in the next batch.  Histograms are added as they come, so a node holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        for batch in batches:
            for t, path, whole, payload in zip(*(batch.column(c).to_pylist() for c in ("tree", "path", "whole", "payload"))):
                if now != (t, path, whole):
                    if now is not None:
                        found.append((now[0], now[1], _split_node(plan, round_, *now, held)))
                    now, held = (t, path, whole), []
                if held and not whole:
                    held = [(np.frombuffer(held[0]) + np.frombuffer(payload)).tobytes()]
                else:
                    held.append(payload)
            if len(found) >= 32:
                yield _pieces_batch(round_, found)
                found = []
        if now is not None:
            found.append((now[0], now[1], _split_node(plan, round_, *now, held)))
        if found:
            yield _pieces_batch(round_, found)

    return run


# ------------------------------------------------------------------ rounds within a barrier stage
class Peers:
    """The tasks of a barrier stage, which all run at the same time.  They hand each other bytes as files of
    the shared folder and wait for a peer's file by its name (a barrier of Spark costs a second).  A task
    that has written a step's file has read all it needs of the steps before, so files go when all have."""

    def __init__(self, uri: str):
        context = BarrierTaskContext.get()
        self.me, self.tasks, self.step, self.kept = context.partitionId(), len(context.getTaskInfos()), 0, []
        if self.tasks > 1:
            attempt = context.allGather(str(context.taskAttemptId()))[0]   # a repeated stage has files of its own
            self.store, self.root = file_system(f"{uri}/{attempt}")
            self.store.create_dir(self.root, recursive=True)

    def _path(self, task: int) -> str:
        return f"{self.root}/{self.step}-{task}"

    def _put(self, parts: Sequence[bytes]) -> None:
        ends = 8 * (len(parts) + 1) + np.cumsum([0, *map(len, parts)], dtype=np.int64)
        path = self._path(self.me)
        with self.store.open_output_stream(f"{path}.part") as out:
            for part in (ends.tobytes(), *parts):
                out.write(part)
        self.store.move(f"{path}.part", path)
        self.kept.append(path)

    def _get(self, task: int, part: int, parts: int, more: int = -1) -> bytes | tuple[bytes, bytes]:
        path, pause = self._path(task), 0.0005
        while self.store.get_file_info(path).type == fs.FileType.NotFound:   # Spark ends this task if a peer is lost
            time.sleep(pause)
            pause = min(1.25 * pause, 0.004)
        with self.store.open_input_file(path) as f:
            ends = np.frombuffer(f.read(8 * (parts + 1)), np.int64)
            f.seek(int(ends[part]))
            data = f.read(int(ends[part + 1] - ends[part]))
            if more < 0:
                return data
            f.seek(int(ends[more]))
            return data, f.read(int(ends[more + 1] - ends[more]))

    def swap(self, parts: Sequence[bytes]) -> list[bytes]:
        """Send every task its part, or all of them the only one; what all tasks sent to this one."""
        if self.tasks == 1:
            return list(parts)
        self.step += 1
        old, self.kept = self.kept, []
        self._put(parts)
        got = [self._get(task, self.me if len(parts) > 1 else 0, len(parts)) for task in range(self.tasks)]
        for path in old:
            self.store.delete_file(path)
        return got

    def swap_and_tell(self, parts: Sequence[bytes], found: list, senders: Sequence[int]) -> tuple[list[bytes], list]:
        """Both in one step: what the senders sent to this task, and what they found."""
        if self.tasks == 1:
            return list(parts), found
        self.step += 1
        if self.me in senders:
            self._put([*parts, pickle.dumps(found)])
        got = [self._get(task, self.me, self.tasks + 1, self.tasks) if task in senders else (b"", b"") for task in range(self.tasks)]
        return [data for data, _ in got], [x for _, told in got if told for x in pickle.loads(told)]

    def tell(self, found: list, senders: Sequence[int]) -> list:
        """What all senders found, in their order."""
        if self.tasks == 1:
            return found
        self.step += 1
        if self.me in senders:
            self._put([pickle.dumps(found)])
        return [x for task in senders for x in pickle.loads(self._get(task, 0, 1))]


def _parts(sizes: Sequence[int], limit: int) -> Iterator[list[int]]:
    """Places of consecutive items, ``limit`` together (or a single one)."""
    held, n = [], 0
    for i, size in enumerate(sizes):
        if held and n + size > limit:
            yield held
            held, n = [], 0
        held.append(i)
        n += size
    if held:
        yield held


def _owners(sizes: Sequence[int], tasks: int) -> list[list[int]]:
    """Items dealt to tasks, the largest first to the task that has least."""
    owned, load = [[] for _ in range(tasks)], [0] * tasks
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        task = load.index(min(load))
        owned[task].append(i)
        load[task] += sizes[i]
    return owned


class Grower:
    """One round of all trees over the rows of this task, in step with its peers.  As many trees as
    ``BATCH_ROWS`` allows grow together, so what a task holds besides its rows and margins is bounded."""

    def __init__(self, plan: Plan, round_: int, peers: Peers, sizes: Sequence[int]):
        self.plan, self.round, self.peers = plan, round_, peers
        self.live = [t for t in range(plan.trees) if round_ < plan.models[t // plan.outputs].n_estimators and sizes[t // plan.outputs] > 0]
        self.sizes = {t: int(sizes[t // plan.outputs]) for t in self.live}
        self._start(self.live)
        self.mine: list[tuple[int, str, dict]] = []     # pieces that this task stores

    def _start(self, trees: Sequence[int]) -> None:
        share = -(-min(sum(self.sizes[t] for t in trees), self.plan.batch_rows * self.peers.tasks) // self.peers.tasks)
        self.counted = self.plan.counted or share <= self.plan.count_rows
        self.share = max(share // 4, min(share, FEW_ROWS))     # several nodes a task, so that all have as much to do
        self.opened, self.small = {}, {}       # rows of nodes that histograms split, and that one task finishes
        self.pieces: dict[int, dict[str, dict]] = {t: {} for t in trees}
        self.found: dict[int, np.ndarray] = {}          # rows whose leaf the task that grew it has told

    def grow(self, columns: np.ndarray, margin: list[np.ndarray], label, fold, row) -> None:
        """``columns`` are (features, rows) bins, ``margin`` is an array per tree."""
        plan, key, batch = self.plan, None, []
        models = sorted({t // plan.outputs for t in self.live}, key=lambda m: (plan.held[m], m))   # those that see the same rows in turn
        limit, waiting, begun = plan.batch_rows * self.peers.tasks, 0, []
        for m in models:
            if key != (key := (plan.held[m], None if plan.models[m].subsample >= 1.0 else m)):
                used = ((fold == plan.held[m]) == plan.invert) & plan.drawn(row, self.round, m)
                used = np.arange(len(fold)) if used.all() else np.flatnonzero(used)
                mine, labels = columns if len(used) == len(fold) else columns.take(used, axis=1), label.take(used)
            derivatives = self._derivatives(margin, labels, used, m)
            for k in range(plan.outputs):
                t = m * plan.outputs + k
                if begun and waiting + self.sizes[t] > limit:
                    self._grow_together(begun, columns, margin)
                    waiting, begun = 0, []
                begun, waiting = [*begun, (t, mine, used, derivatives[k])], waiting + self.sizes[t]
        if begun:
            self._grow_together(begun, columns, margin)

    def _derivatives(self, margin, label, used, m: int) -> list[np.ndarray]:
        """(2, rows) first and second derivatives of each output, in units of the quantum."""
        plan, first = self.plan, m * self.plan.outputs
        out = [np.empty((2, len(used)), plan.kind(m)) for _ in range(plan.outputs)]
        for a in range(0, len(used), SEND_ROWS):
            here = used[a:a + SEND_ROWS]
            g, h = plan.derivatives(np.stack([margin[first + k].take(here) for k in range(plan.outputs)], axis=1), label[a:a + SEND_ROWS], m)
            for k in range(plan.outputs):
                out[k][:, a:a + SEND_ROWS] = g[k] * QUANTUM, h[k] * QUANTUM
        return out

    def _grow_together(self, begun: list[tuple], columns: np.ndarray, margin: list[np.ndarray]) -> None:
        self._start([t for t, *_ in begun])
        if any(self.plan.models[t // self.plan.outputs].subsample < 1.0 for t in self.pieces):   # rows that the round draws
            rows = np.array([len(used) for _, _, used, _ in begun]).tobytes()
            rows = np.sum([np.frombuffer(b, np.int64) for b in self.peers.swap([rows])], axis=0)
            self.sizes.update(zip(self.pieces, rows.tolist()))
        for t, mine, used, derivatives in begun:
            c = np.empty(len(used), dtype=complex)
            c.real, c.imag = derivatives / QUANTUM
            self.found[t] = np.zeros(columns.shape[1], dtype=bool)
            self._deal(t, {"": self.sizes[t]}, used, mine, c, np.zeros(len(used), dtype=np.int64), None)
        while self.opened:
            self._level()
        self._finish(margin)
        for t, found in self.found.items():
            rest = np.flatnonzero(~found)
            if len(rest):
                tree = Tree(self.pieces[t])
                margin[t][rest] += tree.of_columns(columns if len(rest) == columns.shape[1] else columns.take(rest, axis=1))
        if self.peers.me == 0:
            self.mine += [(t, path, piece) for t, pieces in self.pieces.items() for path, piece in pieces.items()]

    def _finishes(self, t: int, path: str, n: int) -> bool:
        """Whether one task gets a node's rows: they are a small part of a task's share, and few bytes, or fewer
        than the histograms of the node and all below it."""
        levels = min(self.plan.models[t // self.plan.outputs].max_depth - len(path), 20)
        cells = hist_bytes(((1 << levels) - 1) * self.peers.tasks, self.plan.n_features)
        row = 2 * self.plan.kind(t // self.plan.outputs).itemsize + self.plan.n_features
        return n <= min(self.plan.finish_rows, self.share) and (levels <= 0 or n * row <= max(cells, FEW_BYTES))

    def _deal(self, t: int, nodes: Mapping[str, int], ids, columns, c, at, above) -> None:
        """``ids`` are places of the rows, ``above`` has a pair of nodes' sums before it was split, if it is kept."""
        keep, number, kept = [], np.full(len(nodes), -1), list(nodes.items())
        for i, (path, n) in enumerate(kept):
            if not self._finishes(t, path, n):
                number[i] = len(keep)
                keep.append(i)
        if len(keep) < len(kept):
            order = np.argsort(at.astype(np.uint16) if len(kept) <= 1 << 16 else at, kind="stable")
            ends = np.searchsorted(at.take(order), np.arange(len(kept) + 1))
            for i, (path, n) in enumerate(kept):
                if number[i] < 0:
                    k = order[ends[i]:ends[i + 1]]
                    self.small[t, path] = n, ids.take(k), columns.take(k, axis=1), c.take(k)
        if keep:
            if len(keep) < len(kept):
                on = np.flatnonzero((number >= 0).take(at))
                ids, columns, c, at = ids.take(on), columns.take(on, axis=1), c.take(on), number.take(at.take(on))
            pairs = {int(number[i]): above[i // 2] for i in keep if number[i ^ 1] >= 0} if above is not None else {}
            self.opened[t] = [kept[i] for i in keep], ids, columns, c, at, pairs

    def _level(self) -> None:
        """Split all open nodes by their histograms; the rows go on to the children."""
        nodes, sums = [], []
        for t, (paths, _, columns, c, at, pairs) in self.opened.items():
            nodes += [(t, path, n) for path, n in paths]
            sums.append(self._sums(t, len(paths), columns, c, at, pairs))
        sums = np.concatenate(sums)
        for group in _parts([sums[0].nbytes] * len(nodes), HISTOGRAM_BYTES):
            self._split([nodes[i] for i in group], sums[group])
        now, self.opened, going, first_node = self.opened, {}, [], 0
        for t, (paths, ids, columns, c, at, _) in now.items():
            first, cuts, children, parents = np.full(len(paths), -1), np.zeros((3, len(paths)), dtype=np.int64), [], []
            for i, (path, _) in enumerate(paths):
                piece = self.pieces[t][path]
                if len(piece["left"]) > 1:
                    first[i] = len(children)
                    children += [path + "L", path + "R"]
                    parents.append(i)
                    cuts[:, i] = piece["feature"][0], piece["bin"][0], piece["default_left"][0]
            mine, first_node = sums[first_node:first_node + len(paths)], first_node + len(paths)
            if not children:
                continue
            if (first < 0).any():
                on = np.flatnonzero((first >= 0).take(at))
                ids, columns, c, at = ids.take(on), columns.take(on, axis=1), c.take(on), at.take(on)
            cell = columns.ravel().take(cuts[0].take(at) * len(at) + np.arange(len(at)))
            left = side_of_bins(cuts[1], cuts[2]).ravel().take((at << 8) + cell)
            at = first.take(at) + ~left
            going.append((t, children, ids, columns, c, at, mine[parents], np.bincount(at, minlength=len(children))))
        if not going:
            return
        if not self.counted:
            counts = np.concatenate([counts for *_, counts in going])
            counts = np.sum([np.frombuffer(b, np.int64) for b in self.peers.swap([counts.tobytes()])], axis=0)
        for t, children, ids, columns, c, at, above, own in going:
            if self.counted:
                rows = [n for path in children[::2] for n in self.pieces[t][path[:-1]]["rows"][1:]]
            else:
                rows, counts = counts[:len(own)], counts[len(own):]
                for path, pair in zip(children[::2], rows.reshape(-1, 2)):
                    self.pieces[t][path[:-1]]["rows"][1:] = pair
            goes = [self.pieces[t][path[:-1]]["left"][0] == OPEN for path in children]
            if all(goes):            # nodes of a level have one depth: all are open, or all have leaves below
                self._deal(t, {path: int(n) for path, n in zip(children, rows)}, ids, columns, c, at, None if self.counted else above)

    def _sums(self, t: int, n: int, columns, c, at, pairs: Mapping[int, np.ndarray]) -> np.ndarray:
        """Histograms of this task's rows, by node: (features, 257) pair sums, the last of them the number of missing
        values, or (3, features, 256) sums with counts."""
        plan, features = self.plan, np.flatnonzero(self.plan.allowed(self.round, t))
        if self.counted:
            out, g, h = np.zeros((n, 3, plan.n_features, 256)), np.ascontiguousarray(c.real), np.ascontiguousarray(c.imag)
            for f in features:
                out[:, :, f] = cell_sums(columns[f], g, h, at, n).transpose(1, 0, 2)
            return out
        out, slot = np.zeros((n, plan.n_features, 257), dtype=complex), np.arange(n)
        rows = np.bincount(at, minlength=n)
        larger = {i + (rows[i + 1] > rows[i]): i + (rows[i + 1] <= rows[i]) for i in sorted(pairs)[::2]}   # and the smaller one
        if larger:
            slot[list(larger)] = -1
            slot[slot >= 0] = np.arange(n - len(larger))
            on = np.flatnonzero((slot >= 0).take(at))
            columns, c, at = columns.take(on, axis=1), c.take(on), slot.take(at.take(on))
        here, sums = np.flatnonzero(slot >= 0), pair_sums(columns, c, at, n - len(larger), features)
        for f, own in zip(features, sums):
            out[here, f, :256] = own
            gone = np.flatnonzero(columns[f] == MISSING)
            if len(gone):
                out[here, f, 256] = np.bincount(at.take(gone), minlength=len(here))
        for i, other in larger.items():
            out[i] = pairs[i] - out[other]
        return out

    def _split(self, nodes: list[tuple[int, str, int]], sums: np.ndarray) -> None:
        plan, peers, kind = self.plan, self.peers, sums.dtype

        def split(places, got):
            total = np.sum([np.frombuffer(b, kind).reshape(-1, *sums.shape[1:]) for b in got], axis=0)
            return [(t, path, _split_node(plan, self.round, t, path, False, [hist.tobytes()]) if self.counted else
                     _split_pair_sums(plan, self.round, t, path, hist, n)) for (t, path, n), hist in zip((nodes[i] for i in places), total)]

        if len(nodes) <= FEW_NODES:     # every task splits them, which saves a step
            self._know(split(range(len(nodes)), peers.swap([sums.tobytes()])))
            return
        shares = np.array_split(np.arange(len(nodes)), peers.tasks)
        got = peers.swap([sums[s].tobytes() for s in shares])
        self._know(peers.tell(split(shares[peers.me], got) if len(shares[peers.me]) else [], [i for i, s in enumerate(shares) if len(s)]))

    def _finish(self, margin: list[np.ndarray]) -> None:
        """Every small node's rows go to one task, which grows it to its end and tells each row's leaf."""
        plan, peers, waiting = self.plan, self.peers, list(self.small)
        for group in _parts([self.small[key][0] for key in waiting], 2 * peers.tasks * FINISH_ROWS):
            keys = [waiting[i] for i in group]
            owned = [[keys[i] for i in o] for o in _owners([self._work(*key) for key in keys], peers.tasks)]
            ids = {key: self.small[key][1] for key in keys}
            got = peers.swap([self._rows(o) for o in owned])
            found, leaves = self._grow_owned(owned[peers.me], got)
            told, pieces = peers.swap_and_tell([b"".join(x) for x in leaves], found, [i for i, o in enumerate(owned) if o])
            self._know(pieces)
            for o, b in zip(owned, told):
                leaf, at = np.frombuffer(b, np.int32), 0
                for t, path in o:
                    place = ids[t, path]
                    margin[t][place] += self.pieces[t][path]["value"].take(leaf[at:at + len(place)])
                    self.found[t][place] = True
                    at += len(place)

    def _work(self, t: int, path: str) -> int:
        n = self.small[t, path][0]
        return n * max(1, min(self.plan.models[t // self.plan.outputs].max_depth - len(path), n.bit_length()))

    def _grow_owned(self, keys: list[tuple[int, str]], got: list[bytes]) -> tuple[list[tuple[int, str, dict]], list[list[bytes]]]:
        """The pieces of this task's nodes, and for each task the leaves of its rows."""
        plan, found, leaves = self.plan, [], [[] for _ in got]
        counts, ends = [np.frombuffer(b, np.int64, len(keys)) for b in got], [8 * len(keys)] * len(got)
        for i, (t, path) in enumerate(keys):
            model, n = t // plan.outputs, int(sum(x[i] for x in counts))
            p, kind = plan.models[model], plan.kind(model)
            columns, c, at = np.empty((plan.n_features, n), np.uint8), np.empty(n, dtype=complex), 0
            for k, b in enumerate(got):
                size, end = int(counts[k][i]), ends[k]
                g, h = np.frombuffer(b, kind, 2 * size, end).reshape(2, size)
                c.real[at:at + size], c.imag[at:at + size] = g / QUANTUM, h / QUANTUM
                end += 2 * size * kind.itemsize
                columns[:, at:at + size] = np.frombuffer(b, np.uint8, plan.n_features * size, end).reshape(plan.n_features, size)
                at, ends[k] = at + size, end + plan.n_features * size
            piece, leaf = grown(columns, c, p.max_depth - len(path), plan.allowed(self.round, t), p)
            found.append((t, path, piece))
            at = 0
            for k in range(len(got)):
                size = int(counts[k][i])
                leaves[k].append(leaf[at:at + size].tobytes())
                at += size
        return found, leaves

    def _rows(self, keys: list[tuple[int, str]]) -> bytes:
        counts, out = [], []
        for t, path in keys:
            _, _, columns, c = self.small.pop((t, path))
            kind = self.plan.kind(t // self.plan.outputs)
            counts.append(len(c))
            out += [(c.real * QUANTUM).astype(kind).tobytes(), (c.imag * QUANTUM).astype(kind).tobytes(), columns.tobytes()]
        return b"".join([np.array(counts, dtype=np.int64).tobytes(), *out])

    def _know(self, found: list[tuple[int, str, dict]]) -> None:
        for t, path, piece in found:
            self.pieces[t][path] = piece


def _rounds(plan: Plan, first: int, until: int, sizes: Sequence[int], root: str, keep_trees: bool, name: str = "", tree: int = 0):
    """Rounds ``first`` to ``until`` in a barrier stage: the rows of a task with their new margins; the
    pieces are stored, their trees numbered from ``tree``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peers = Peers(f"{root}/peers-{name}{first}")
        kept, bins, held = [], [np.zeros((plan.n_features, 0), np.uint8)], [np.zeros((plan.trees, 0))]
        for batch in _chunks(batches, CHUNK_ROWS):
            kept.append(batch.select(["id", "row", "label", "fold"]))
            bins.append(np.ascontiguousarray(_fixed(batch.column("bins"), np.uint8, plan.n_features).T))
            held.append(np.ascontiguousarray(_fixed(batch.column("margin"), np.float64, plan.trees).T) if first else
                        np.repeat(np.repeat(np.array(plan.base), plan.outputs)[:, None], batch.num_rows, axis=1))
        columns, margin = np.concatenate(bins, axis=1), [np.concatenate([h[t] for h in held]) for t in range(plan.trees)]
        del bins, held
        label, fold, row = (np.concatenate([np.asarray(b.column(c)) for b in kept]) if kept else np.zeros(0, np.int64) for c in ("label", "fold", "row"))
        stored = []
        for round_ in range(first, until):
            grower = Grower(plan, round_, peers, sizes)
            grower.grow(columns, margin, label, fold, row)
            if keep_trees and grower.mine:
                stored.append(_pieces_batch(round_, [(t + tree, path, piece) for t, path, piece in grower.mine]))
        if stored:
            store, folder = file_system(f"{root}/trees/rounds-{name}{first}")
            store.create_dir(folder, recursive=True)
            pq.write_table(pa.Table.from_batches(stored), f"{folder}/part-{peers.me}.parquet", filesystem=store)
        step, at = _chunk_rows(plan), 0
        while kept:
            whole = kept.pop(0)
            for a in range(0, whole.num_rows, step):
                part = whole.slice(a, step)
                to, at = slice(at, at + part.num_rows), at + part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _binaries(columns[:, to].T), _binaries(np.stack([m[to] for m in margin], axis=1))],
                    ["id", "row", "label", "fold", "bins", "margin"])

    return run


# ---------------------------------------------------------------------------------- the driver
def feature_cuts(data: DataFrame, features: Sequence[str], bins: int = MISSING) -> list[list[float]]:
    """Ascending thresholds per feature: quantiles over all rows (bin b holds the values in
    (cut[b-1], cut[b]]); at most ``bins - 1`` of them."""
    shares = [float(i) / bins for i in range(1, bins)]
    values = data.select(*[F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")).alias(f"c{i}")
                           for i, f in enumerate(features)])
    row = values.agg(*[F.percentile_approx(f"c{i}", F.array(*[F.lit(s) for s in shares]), F.lit(20_000)).alias(f"c{i}")
                       for i in range(len(features))]).first()
    return [sorted(set(c or [])) for c in row]


def binned(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of a (rows, features) matrix; NaN has the missing bin."""
    out = np.empty(x.shape, dtype=np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(np.asarray(c, dtype=float), x[:, f], side="left"))
    return out


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for n in names]) \
        if len(names) else np.zeros((batch.num_rows, 0))


def numbers(features: Sequence[str], prefix: str = "__f") -> list:
    """The features as doubles (NULL for NaN), under names that cannot clash."""
    return [F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")).alias(f"{prefix}{i}") for i, f in enumerate(features)]


def _start(plan: Plan, cuts, margins: bool):
    names = [f"__f{i}" for i in range(len(cuts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.repeat(np.array(plan.base), plan.outputs).tobytes() if margins else b""
        for batch in batches:
            b = binned(_matrix(batch, names), cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), batch.column("label"), batch.column("fold"),
                 _binaries(b), pa.array([first] * batch.num_rows, pa.binary())],
                ["id", "row", "label", "fold", "bins", "margin"])

    return run


def _refresh(plan: Plan, folders: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, _chunk_rows(plan)):
            bins, margin = _columns(batch, plan)
            _advance(margin, bins, folders)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", _binaries(margin))

    return run


def _delete(spark: SparkSession, path: str) -> None:
    """Release a table of this job that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _left_out(plan: Plan, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, margin = _columns(batch, plan)
            fold = np.asarray(batch.column("fold"))
            rows, models = np.nonzero(~plan.sees(fold))
            each = margin.reshape(len(fold), len(plan.models), plan.outputs)[rows, models]
            pred = (each[:, 0] > 0).astype(np.int32) if plan.outputs == 1 else each.argmax(axis=1).astype(np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array((models + first).astype(np.int32)), batch.column("fold").take(take),
                 batch.column("label").take(take), pa.array(pred)], ["id", "model", "fold", "label", "prediction"])

    return run


@dataclass
class Trained:
    """A finished job: margins of every row (id, label, fold) in every model, and its trees.  Models that
    trained in turn are several parts (the first model, the plan, the rows with the margins of its models)."""

    plan: Plan
    cuts: list[list[float]]
    features: list[str]
    parts: list[tuple[int, Plan, DataFrame]]
    folder: str | None

    @property
    def state(self) -> DataFrame:
        """Rows with the margins of all models."""
        out = self.parts[0][2]
        for _, _, other in self.parts[1:]:
            out = out.join(other.select("row", F.col("margin").alias("__more")), "row").withColumn("margin", F.concat("margin", "__more")).drop("__more")
        return out

    def held_out(self) -> DataFrame:
        """(id, model, fold, label, prediction) for every row in the models that left it out."""
        out = None
        for first, plan, state in self.parts:
            said = state.mapInArrow(_left_out(plan, first), f"id {state.schema['id'].dataType.simpleString()}, model int, fold int, label int, prediction int")
            out = said if out is None else out.unionAll(said)
        return out

    def model(self, index: int = 0) -> "BoostedModel":
        """Model ``index`` with its trees in a folder of their own."""
        if self.folder is None:
            raise ValueError("the trees of this job were not kept")
        spark, k = self.parts[0][2].sparkSession, self.plan.outputs
        trees = spark.read.schema(PIECE_SCHEMA).option("recursiveFileLookup", "true").parquet(self.folder)
        mine = trees.where(F.floor(F.col("tree") / F.lit(k)) == index).withColumn("tree", (F.col("tree") - F.lit(index * k)).cast("int"))
        folder = shared_path(spark, "boosted")
        mine.repartition(spark.sparkContext.defaultParallelism, "round", "tree").write.parquet(folder)
        return BoostedModel(list(self.features), self.cuts, self.plan.models[index], self.plan.base[index], k, folder)


def _models_together(plan: Plan, rows: int, tasks: int) -> int:
    """Models that train in one barrier stage, as many as its tasks can hold the margins of; the others follow in
    stages of their own.  None where not even one fits, or without barrier stages."""
    room = HELD_BYTES * tasks // rows - plan.n_features - 64
    fit = min(len(plan.models), max(0, room) // (16 * plan.outputs))
    return -(-len(plan.models) // -(-len(plan.models) // fit)) if fit else 0


def train(data: DataFrame, features: Sequence[str], label: str, models: Sequence[Params], n_classes: int = 2,
          id_col: str | None = None, fold_col: str | None = None, folds: int = 0, keep_trees: bool = True,
          finish_rows: int = FINISH_ROWS, invert: bool = False) -> Trained:
    """Grow all ``models`` together; with ``folds`` each of them once per fold, leaving it out.

    Model ``i`` without fold ``f`` (with ``invert``: on it alone) has number ``i * folds + f``.  Rows without a label take no
    part; labels are 0..n_classes-1.  A table without labelled rows is refused.
    """
    spark = data.sparkSession
    ship_package(spark)
    fold = F.coalesce(F.col(f"`{fold_col}`").cast("int"), F.lit(-2)) if fold_col else F.lit(-2)
    label_of = F.col(f"`{label}`").cast("int")
    rows = data.where(label_of.isNotNull()).select(
        (F.col(f"`{id_col}`") if id_col else F.lit(None).cast("long")).alias("id"), F.monotonically_increasing_id().alias("row"),
        label_of.alias("label"), fold.alias("fold"), *numbers(features))
    cuts = feature_cuts(data.where(label_of.isNotNull()), features)
    counts = [(r["fold"], r["label"], r["n"]) for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counts or min(c[1] for c in counts) < 0 or max(c[1] for c in counts) >= n_classes:
        raise ValueError(f"labels must be whole numbers from 0 to {n_classes - 1}, and there must be some")
    all_models, held = (([m for m in models for _ in range(folds)], [f for _ in models for f in range(folds)]) if folds
                        else (list(models), [-1] * len(models)))
    own = [[(c, n) for f, c, n in counts if (f == h) == invert] for h in held]
    sizes = [sum(n for _, n in o) for o in own]
    outputs = 1 if n_classes == 2 else n_classes
    base = []
    for m, o in zip(all_models, own):
        pos, neg = m.scale_pos_weight * sum(n for c, n in o if c == 1), sum(n for c, n in o if c == 0)
        base.append(math.log(max(pos, 1e-6) / max(neg, 1e-6)) if outputs == 1 else 0.0)
    plan = Plan(tuple(all_models), tuple(held), invert, tuple(base), outputs, len(features), finish_rows, BATCH_ROWS, COUNT_ROWS,
                any(m.min_child_weight <= 0 for m in models))

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, label int, fold int, bins binary, margin binary"
    root = shared_path(spark, "boosting")
    state_path = f"{root}/state-0"
    # a small table is dealt to a task per ROW_TREES rows x trees, a large one stays as it is read
    total, cores = sum(n for _, _, n in counts), spark.sparkContext.defaultParallelism
    if total <= ROW_TREES * cores:
        rows = rows.repartition(min(cores, max(1, math.ceil(total * plan.trees / ROW_TREES))))
    tasks = min(task_slots(spark), max(1, math.ceil(total * plan.trees / ROW_TREES)))
    together = _models_together(plan, total, tasks)
    rows.mapInArrow(_start(plan, cuts, not together), schema).write.parquet(state_path)
    state = spark.read.schema(schema).parquet(state_path)
    every, waiting = max(1, min(16, int(math.sqrt(WALK * cores / (total * plan.trees))))), []
    store, _ = file_system(root)
    last = max(m.n_estimators for m in all_models) - 1

    if together:
        parts = []
        for a in range(0, len(all_models), together):
            to = slice(a, a + together)
            part = replace(plan, models=plan.models[to], held=plan.held[to], base=plan.base[to])
            grown_state, grown_path, name = state, None, f"{a}-"
            rounds_of_part = max(m.n_estimators for m in part.models)
            for first in range(0, rounds_of_part, ROUNDS):
                until = min(first + ROUNDS, rounds_of_part)
                new_path = f"{root}/state-{name}{until}"
                rounds = _rounds(part, first, until, sizes[to], root, keep_trees, name, a * outputs)
                grown_state.repartition(tasks, "row").mapInArrow(rounds, schema, barrier=True).write.parquet(new_path)
                if grown_path:
                    _delete(spark, grown_path)
                _delete(spark, f"{root}/peers-{name}{first}")
                grown_state, grown_path = spark.read.schema(schema).parquet(new_path), new_path
            parts.append((a, part, grown_state))
        _delete(spark, state_path)
        return Trained(plan, cuts, list(features), parts, f"{root}/trees" if keep_trees else None)

    def grown_nodes(opened: dict, begun: dict) -> DataFrame:
        n = sum(len(nodes) for nodes in opened.values())
        sent = state.mapInArrow(_emit(plan, round_, waiting, begun, opened), "tree int, path string, whole boolean, payload binary")
        sent = sent.repartition(max(1, min(n, 4 * cores)), "tree", "path").sortWithinPartitions("tree", "path")
        return sent.mapInArrow(_reduce(plan, round_), PIECE_SCHEMA)

    for round_ in range(last + 1):
        folder, begun, whole = f"{root}/trees/round-{round_}", {}, {}
        opened = {t: {"": sizes[t // outputs]} for t in range(plan.trees)
                  if round_ < all_models[t // outputs].n_estimators and sizes[t // outputs] > 0}
        while opened:
            for t, nodes in opened.items():
                for path, n in nodes.items():
                    if n <= finish_rows:
                        whole.setdefault(t, {})[path] = True
            large = {t: {path: False for path, n in nodes.items() if n > finish_rows} for t, nodes in opened.items()}
            large = {t: nodes for t, nodes in large.items() if nodes}
            opened = {}
            if not large:
                break
            # each piece of these is one split and stands for more than finish_rows rows
            for r in grown_nodes(large, begun).collect():
                piece = {name: np.array(r[name]) for name in FIELDS}
                begun.setdefault(r["tree"], {})[r["path"]] = piece
                if piece["left"][0] == OPEN:
                    opened.setdefault(r["tree"], {}).update(zip((r["path"] + "L", r["path"] + "R"), r["rows"][1:]))
        if whole:
            grown_nodes(whole, begun).write.parquet(f"{folder}/finished")
        if begun:
            store.create_dir(f"{file_system(folder)[1]}/split", recursive=True)
            pieces = _pieces_batch(round_, [(t, path, piece) for t, nodes in begun.items() for path, piece in nodes.items()])
            pq.write_table(pa.Table.from_batches([pieces]), f"{file_system(folder)[1]}/split/part-0.parquet", filesystem=store)
        waiting.append(folder)
        if len(waiting) == every or round_ == last:
            new_path = f"{root}/state-{round_ + 1}"
            state.mapInArrow(_refresh(plan, waiting), schema).write.parquet(new_path)
            _delete(spark, state_path)
            state, state_path = spark.read.schema(schema).parquet(new_path), new_path
            if not keep_trees:
                for w in waiting:
                    _delete(spark, w)
            waiting = []
    return Trained(plan, cuts, list(features), [(0, plan, state)], f"{root}/trees" if keep_trees else None)


# ------------------------------------------------------------------------------------ the model
@dataclass
class BoostedModel:
    """A trained booster: how features are binned, where a margin starts, and its trees, Parquet
    rows in ``folder`` of the shared storage."""

    features: list[str]
    cuts: list[list[float]]
    params: Params
    base: float
    outputs: int
    folder: str

    def pieces(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PIECE_SCHEMA).parquet(self.folder)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: (round, output, node, parent, side, feature, threshold, default_left,
        value, cover, rows, gain, is_leaf).  ``node`` is unique within its tree; ``value`` is the
        node's own Newton step, ``cover`` its sum of second derivatives; the threshold is infinite
        where a split parts missing from present values."""
        names = F.array(*[F.lit(f) for f in self.features])
        limits = F.array(*[F.array(*[F.lit(float(c)) for c in [*cuts, math.inf]]) for cuts in self.cuts])
        cells = F.posexplode(F.arrays_zip(*FIELDS)).alias("k", "n")
        flat = self.pieces(spark).select("round", F.col("tree").alias("output"), "path", "left", "right", cells)
        # below an open node the children are pieces of their own
        real = flat.where((F.col("k") == 0) | (F.get("left", F.lit(0)) != OPEN))
        up = F.expr("transform(sequence(0, size(left) - 1), i -> CASE WHEN left[i] >= 0 THEN struct(left[i] AS l, right[i] AS r, i AS i) END)")
        real = real.withColumn("above", F.get(F.filter(up, lambda x: (x["l"] == F.col("k")) | (x["r"] == F.col("k"))), F.lit(0)))
        name = F.concat("path", F.lit(":"), F.col("k").cast("string"))
        outer = F.when(F.length("path") > 0, F.concat(F.expr("left(path, length(path) - 1)"), F.lit(":0")))
        parent = F.when(F.col("k") > 0, F.concat("path", F.lit(":"), F.col("above.i").cast("string"))).otherwise(outer)
        side = F.when(F.col("k") > 0, F.when(F.col("above.l") == F.col("k"), "L").otherwise("R")).when(F.length("path") > 0, F.expr("right(path, 1)"))
        return real.select(
            "round", "output", name.alias("node"), parent.alias("parent"), side.alias("side"),
            F.when(F.col("n.feature") >= 0, F.get(names, F.col("n.feature"))).alias("feature"),
            F.when(F.col("n.feature") >= 0, F.get(F.get(limits, F.col("n.feature")), F.col("n.bin"))).alias("threshold"),
            F.when(F.col("n.feature") >= 0, F.col("n.default_left")).alias("default_left"),
            F.col("n.value").alias("value"), F.col("n.hess").alias("cover"), F.col("n.rows").alias("rows"), F.col("n.gain").alias("gain"),
            (F.col("n.left") == -1).alias("is_leaf"))

    def margins(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns and ``margin``, an array with one value per output."""
        ship_package(df.sparkSession)
        me, names = self, [f"__f{i}" for i in range(len(self.features))]
        src = df.select(*[F.col(f"`{k}`") for k in keep], *numbers(self.features))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(_matrix(batch, names), me.cuts)
                margin = np.full((batch.num_rows, me.outputs), me.base)
                _advance(margin, bins, [me.folder])
                offsets = np.arange(0, margin.size + 1, me.outputs, dtype=np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(margin.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], out], [*keep, "margin"])

        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
        return src.mapInArrow(run, f"{kinds}{', ' if keep else ''}margin array<double>")


def save(model: BoostedModel, path: str, spark: SparkSession) -> str:
    """Persist a model (S4): its trees and a small description, the description last."""
    model.pieces(spark).write.mode("overwrite").parquet(f"{path}/trees")
    about = {"features": model.features, "cuts": model.cuts, "params": asdict(model.params), "base": model.base, "outputs": model.outputs}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def load(spark: SparkSession, path: str) -> BoostedModel:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    return BoostedModel(about["features"], about["cuts"], Params(**about["params"]), about["base"], about["outputs"], f"{path}/trees")


def fit(data: DataFrame, features: Sequence[str], label: str, params: Params = Params(), n_classes: int = 2,
        finish_rows: int = FINISH_ROWS) -> BoostedModel:
    """One booster (M5; M6 for more than two classes)."""
    return train(data, features, label, [params], n_classes, finish_rows=finish_rows).model()


def probabilities(margin, outputs: int):
    """Class probabilities of a margin array column: logistic or softmax."""
    if outputs == 1:
        p = 1.0 / (1.0 + F.exp(-F.get(margin, F.lit(0))))
        return F.array(1.0 - p, p)
    e = F.transform(margin, lambda m: F.exp(m - F.array_max(margin)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def score(model: BoostedModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``prediction`` and, for two classes, ``probability`` of class 1; for more,
    ``probabilities`` (M12, M13).  Ties go to the lower class."""
    out = model.margins(df, keep)
    p = probabilities(F.col("margin"), model.outputs)
    if model.outputs == 1:
        return out.select(*keep, (F.get("margin", F.lit(0)) > 0).cast("int").alias("prediction"), F.get(p, F.lit(1)).alias("probability"))
    return out.select(*keep, (F.array_position("margin", F.array_max("margin")) - 1).cast("int").alias("prediction"), p.alias("probabilities"))


# ------------------------------------------------------------------------- search and fold loop
def f1_score(held_out: DataFrame, by: Sequence[str], positive: int = 1) -> DataFrame:
    """F1 of the positive class per group (M8): 2 tp / (support + predicted), 0 where there is none."""
    yes, said = F.col("label") == positive, F.col("prediction") == positive
    sums = held_out.groupBy(*by).agg(F.sum((yes & said).cast("long")).alias("tp"),
                                     F.sum(yes.cast("long") + said.cast("long")).alias("both"))
    return sums.select(*by, F.when(F.col("both") > 0, 2 * F.col("tp").cast("double") / F.col("both")).otherwise(0.0).alias("f1"))


def search(data: DataFrame, features: Sequence[str], label: str, fold_col: str, folds: int, draws: Sequence[Mapping[str, float]],
           rounds: int, seed: int = 0, positive: int = 1, id_col: str | None = None,
           finish_rows: int = FINISH_ROWS) -> tuple[Params, DataFrame, Trained]:
    """Cross-validated search over drawn parameters (M7): all candidates x folds grow together.

    Returns the best parameters (highest mean F1 of the positive class, the earlier candidate on
    ties), the table of candidates, and the job with every held-out prediction."""
    spark = data.sparkSession
    models = [Params.of(d, n_estimators=rounds, seed=seed + i) for i, d in enumerate(draws)]
    done = train(data, features, label, models, 2, id_col, fold_col, folds, keep_trees=False, finish_rows=finish_rows)
    per = f1_score(done.held_out(), ["model"], positive).withColumn("candidate", (F.col("model") / folds).cast("int"))
    found = {r["candidate"]: r["f1"] for r in per.groupBy("candidate").agg(F.avg("f1").alias("f1")).collect()}  # one per candidate
    best = max(range(len(models)), key=lambda i: (found.get(i, 0.0), -i))
    rows = [(i, m.max_depth, m.learning_rate, m.colsample_bytree, m.scale_pos_weight, m.reg_alpha, m.reg_lambda,
             float(found.get(i, 0.0)), i == best) for i, m in enumerate(models)]
    table = spark.createDataFrame(rows, "candidate int, max_depth int, learning_rate double, colsample_bytree double, "
                                        "scale_pos_weight double, reg_alpha double, reg_lambda double, mean_f1 double, is_best boolean")
    return models[best], table, done


def cross_validate(data: DataFrame, features: Sequence[str], label: str, params: Params, n_classes: int, folds: int,
                   fold_col: str = "fold", id_col: str | None = None, invert: bool = False,
                   finish_rows: int = FINISH_ROWS) -> tuple[DataFrame, DataFrame]:
    """The fold loop (M11): per fold (fold, n_test, accuracy), and every held-out prediction
    (id, fold, label, prediction).  ``invert`` trains on the single fold and scores the others."""
    done = train(data, features, label, [params], n_classes, id_col, fold_col, folds, keep_trees=False, finish_rows=finish_rows,
                 invert=invert)
    said = done.held_out().select("id", F.col("model").alias("fold"), "label", "prediction")
    return fold_accuracy(said), said


def fold_accuracy(said: DataFrame) -> DataFrame:
    """(fold, n_test, accuracy) of held-out predictions."""
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return said.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), right.alias("accuracy"))


def parameter_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every point of a grid of parameters (R4), the last name varying fastest."""
    points = [{}]
    for name, values in grid.items():
        points = [{**p, name: v} for p in points for v in values]
    return points


def importance(model: BoostedModel, spark: SparkSession) -> DataFrame:
    """Per feature its share of the gain (``importance``), of the cover and of the splits, the
    largest first; features that no split uses have zeros (M17)."""
    per = model.nodes(spark).where(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.sum("gain").alias("g"), F.sum("cover").alias("c"), F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(f,) for f in model.features], "feature string").join(per, "feature", "left").na.fill(0)
    whole = Window.partitionBy()
    shares = {"importance": "g", "cover": "c", "frequency": "n"}
    return every.select("feature", *[F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(whole)), F.lit(0.0)).alias(a)
                                     for a, c in shares.items()]).orderBy(F.desc("importance"), "feature")
