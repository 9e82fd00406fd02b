"""Exact top-k search by integer inner product, with multi-resolution segment statistics.

A vector is cut into segments at several resolutions, and of every segment its mean and its
deviation are kept.  Within a segment of w numbers an inner product is at most
``w (mean_q mean_v + deviation_q deviation_v)`` (equivalently, the squared distance is at least
``w ((mean_q - mean_v)^2 + (deviation_q - deviation_v)^2)``), so the sum over the segments bounds
the score of a pair.  Pairs whose bound lies below the k-th best score known for the query go, from
one segment per vector to segments of two numbers; scores of the pairs that are left are computed
exactly.  A bound never decides between scores: it only drops pairs that cannot enter.

Spark: the vectors are written once; the queries (the rows whose id is divisible by ``every``) are
written apart, each with a first threshold from a bounded sample of candidates (any k real scores
are a valid threshold, so the sample bears on speed alone).  Every task holds one chunk of
candidates and reads the queries from the shared folder block by block, so neither side is
broadcast or collected; it emits at most k candidates per query and chunk, and a window keeps the
k best of all.  Pairs are the stated queries against all rows, in blocks.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite components take no part; a
vector meets vectors of its own length only; rows with NULL ids are candidates, not queries, and
come last among equal scores; repeated rows are rows of their own (a row is excluded from its own
query only); an empty table gives no rows; scores beyond a bigint saturate.  Columns that are not
named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.llm.common import filesystem, written

K, EVERY, SCALE = 20, 20, 64
SEED_ROWS = 4096            # candidates that the first thresholds are taken from
CHUNK_ROWS = 131_072        # candidates that a task holds at a time
QUERY_ROWS, BLOCK_ROWS = 512, 4096   # queries and candidates compared at a time
DENSE = 1 / 32              # share of surviving pairs from which a block is multiplied whole
_EXACT = float(1 << 53)     # sums of integers below it are exact in doubles


def segment_counts(d: int) -> list[int]:
    """Segments per vector, coarse to fine: 1, 4, 16, ... and at last segments of two numbers."""
    out, n = [], 1
    while n < d // 2:
        out.append(n)
        n *= 4
    return out + [max(1, d // 2)]


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled (means, deviations) whose products are the bounds."""
    n, d = x.shape
    cuts = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int)) if d else np.array([0])
    if len(cuts) < 2:
        return np.zeros((n, 1))
    width = np.diff(cuts).astype(float)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.hstack([total / np.sqrt(width), np.sqrt(np.maximum(square - total * total / width, 0.0))])


class Block:
    """Rows of one length: integers as doubles, their statistics at every resolution."""

    def __init__(self, x: np.ndarray, statistics: bool = True):
        self.x = x
        self.top = float(np.abs(x).max()) if x.size else 0.0
        self.norm = np.sqrt((x * x).sum(axis=1)) if x.size else np.zeros(len(x))
        self.levels = [segment_statistics(x, s) for s in segment_counts(x.shape[1])] if statistics else []


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)
    top = (1 << 63) - 1  # numbers too large for doubles: Python integers, saturating
    whole = [[[int(v) for v in r] for r in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(r, c)), -top), top) for c in whole[1]] for r in whole[0]],
                    dtype=np.int64).reshape(len(a), len(b))


def surviving_scores(q: Block, v: Block, rows: slice, cols: slice, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the pairs whose bounds reach the thresholds at every resolution
    and whose exact score does."""
    i, j = np.arange(rows.start, rows.stop), np.arange(cols.start, cols.stop)
    exact = q.top * v.top * max(1, q.x.shape[1]) < _EXACT
    mask = np.ones((len(i), len(j)), dtype=bool)
    if exact:
        slack = 1e-9 * (1.0 + q.norm[rows].max(initial=0.0) * v.norm[cols].max(initial=0.0))
        for a, b in zip(q.levels, v.levels):
            mask &= a[i] @ b[j].T >= threshold[i][:, None] - slack
            live_i, live_j = mask.any(axis=1), mask.any(axis=0)
            if not live_i.all() or not live_j.all():
                i, j, mask = i[live_i], j[live_j], mask[np.ix_(live_i, live_j)]
            if not len(i) or not len(j):
                return i[:0], j[:0], np.zeros(0, dtype=np.int64)
    if not exact or mask.mean() >= DENSE:
        score = _product(q.x[i], v.x[j], exact)
        a, b = np.nonzero(mask & (score >= threshold[i][:, None]))
        return i[a], j[b], score[a, b]
    a, b = np.nonzero(mask)
    a, b = i[a], j[b]
    score = np.einsum("ij,ij->i", q.x[a], v.x[b]).astype(np.int64)
    good = score >= threshold[a]
    return a[good], b[good], score[good]


class Best:
    """The k best candidates of every query of a block: higher scores, then smaller ids."""

    def __init__(self, threshold: np.ndarray, k: int):
        self.k, self.threshold = k, threshold.astype(float).copy()
        self.row, self.score, self.ids = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.no_id = np.zeros(0, dtype=bool)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if not len(row):
            return
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        ids, no_id = np.concatenate([self.ids, ids]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((ids, no_id, -score, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        self.row, self.score, self.ids, self.no_id = row[order], score[order], ids[order], no_id[order]
        full = place == self.k - 1
        last = self.score[full].astype(float)
        last = np.where(np.abs(last) < _EXACT, last, last - np.abs(last) * 1e-15)  # never above the integer
        self.threshold[self.row[full]] = np.maximum(self.threshold[self.row[full]], last)


def _matrices(batch: pa.RecordBatch | pa.Table, column: str, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as whole numbers) for every length of vector in the batch."""
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values, dtype=float)
    width = np.diff(offsets)
    for d in np.unique(width):
        at = np.nonzero(width == d)[0]
        yield at, np.floor(scale * flat[offsets[at][:, None] + np.arange(d)].reshape(len(at), d))


def _seeds(sample: Sequence[tuple], vector: str, k: int, scale: float):
    """Adds to every query the k-th best of its scores with the sample (minus infinity if the
    sample has fewer rows of its length)."""
    ids = np.array([r[0] for r in sample], dtype=np.int64)
    by_length: dict[int, list[int]] = {}
    for n, r in enumerate(sample):
        by_length.setdefault(len(r[1]), []).append(n)
    groups = {d: (ids[at], Block(np.floor(scale * np.array([sample[n][1] for n in at], dtype=float).reshape(len(at), d)), False))
              for d, at in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = np.full(batch.num_rows, -np.inf)
            for at, x in _matrices(batch, vector, scale):
                there, block = groups.get(x.shape[1], (None, None))
                q = Block(x, False)
                if block is None or q.top * block.top * max(1, x.shape[1]) >= _EXACT:
                    continue
                for a in range(0, len(at), QUERY_ROWS):
                    score = x[a:a + QUERY_ROWS] @ block.x.T
                    own = np.asarray(batch.column("rid"))[at[a:a + QUERY_ROWS]]
                    score[own[:, None] == there[None, :]] = -np.inf
                    if score.shape[1] >= k:
                        seed[at[a:a + QUERY_ROWS]] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seed)], [*batch.schema.names, "seed"])

    return run


def _search(files: list[str], k: int, scale: float, chunk_rows: int):
    """Candidates of a partition, chunk by chunk, against every block of queries."""

    def queries() -> Iterator[pa.RecordBatch]:
        for uri in files:
            store, path = filesystem(uri)
            with store.open_input_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=QUERY_ROWS)

    def search(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        rid = np.asarray(chunk.column("rid"))
        ids = chunk.column("vec_id")
        no_id = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0))
        blocks = {x.shape[1]: (at, Block(x)) for at, x in _matrices(chunk, "embedding", scale)}
        for batch in queries():
            seed = np.asarray(batch.column("seed"))
            for rows, x in _matrices(batch, "embedding", scale):
                if x.shape[1] not in blocks:
                    continue
                at, block = blocks[x.shape[1]]
                q, best = Block(x), Best(seed[rows], k)
                own = np.asarray(batch.column("rid"))[rows]
                for a in range(0, len(at), BLOCK_ROWS):
                    i, j, score = surviving_scores(q, block, slice(0, len(x)), slice(a, min(a + BLOCK_ROWS, len(at))), best.threshold)
                    other = own[i] != rid[at[j]]
                    i, j, score = i[other], at[j[other]], score[other]
                    best.add(i, score, ids[j], no_id[j])
                take = rows[best.row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(batch.column("rid"))[take]), batch.column("vec_id").take(pa.array(take)),
                     pa.array(best.ids, mask=best.no_id), pa.array(best.score)], ["rid", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk_rows:
                yield from search(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from search(pa.Table.from_batches(held))

    return run


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
                scale: float = SCALE, seed_rows: int = SEED_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ``k`` best rows for every row whose id is divisible by ``every``: (query_id, rank from 1,
    vec_id, score), by the inner product of the components as ``floor(scale * x)``; ties go to the
    smaller id.  Queries with fewer candidates have all of them."""
    def usable(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    rows = written(rows.where(F.forall("embedding", usable)).withColumn("rid", F.monotonically_increasing_id()), "topk-vectors")
    vector = rows.schema["embedding"].dataType.simpleString()
    sample = [tuple(r) for r in rows.select("rid", "embedding").limit(seed_rows).collect()]  # a documented bound
    asked = written(rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(
        _seeds(sample, "embedding", k, scale), f"vec_id long, embedding {vector}, rid long, seed double"), "topk-queries")
    found = rows.mapInArrow(_search(sorted(asked.inputFiles()), k, scale, chunk_rows),
                            "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
