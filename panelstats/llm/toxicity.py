"""Toxicity by cumulative-link ordinal regression.

A document has a severity grade 0 .. 3.  One weight vector over sparse text features (words
and word beginnings) gives a score s, and ordered thresholds t1 < t2 < t3 share it:
P(grade >= k) = sigmoid(s - tk).  The expected severity is the sum of those probabilities.

The labels say toxic or not, so the grades of the toxic documents are set by how much of
their vocabulary is toxic: features that only toxic documents use are found by a test over
the labelled sample, and the documents' numbers of words with such a feature are cut into
thirds.  Fitting uses a bounded sample of labelled rows; scoring reads every document whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import written

SAMPLE_ROWS = 20_000     # labelled documents used to fit, at most
MAX_FEATURES = 4096      # features of the model, at most
# A feature is in at least so many sample documents, is tied to toxicity beyond chance, and
# most of its documents are toxic (lower bound of a 95 % interval of their share).
MIN_DOCS, MIN_Z, MIN_SHARE, INTERVAL_Z = 5, 5.5, 0.5, 1.96
GRADES = 3
REJECT_FROM = 0.6        # P(grade >= 1) from which a document is rejected
STEPS, RATE, RIDGE = 400, 0.1, 1e-3
PREFIXES = (3, 4, 5, 6, 7, 8)
REPEATS = (2, 3)         # a beginning that so many words of a document share is a feature of its own
WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 500_000    # words whose weight a task remembers


def word_features(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def with_repeats(own: Counter) -> Counter:
    """Counts of a document's features, and a feature for every beginning that two (three) or
    more of its words share: one such word may be chance, several are a subject."""
    more = {f"{k}{f}": 1 for f, n in own.items() if f[0] == "^" for k in REPEATS if n >= k}
    return own + Counter(more)


def document_features(text: str | None) -> Counter:
    return with_repeats(Counter(f for w in _distinct_words(text) for f in word_features(w)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature, toxic and all, added up per task."""
    for batch in batches:
        toxic, every = Counter(), Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = document_features(text).keys()
            every.update(own)
            if label:
                toxic.update(own)
        names = list(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()),
             pa.array([every[f] for f in names], pa.int64())], names=["feature", "toxic", "n"])


def _vectors(features: dict[str, int]):
    """Rows (toxic, feature numbers, values): how many distinct words have each feature (1 for
    repeats)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(sorted((features[f], n) for f, n in document_features(text).items() if f in features))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([[i for i, _ in r] for r in rows], pa.list_(pa.int32())),
                 pa.array([[v for _, v in r] for r in rows], pa.list_(pa.int32()))],
                names=["toxic", "key", "at", "value"])

    return run


class OrdinalModel:
    """Weights by feature and ordered thresholds; an empty model scores everything 0."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def probabilities(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, score - t)))) for t in self.thresholds]


def fit_ordinal(rows: list[tuple[list[int], list[float]]], grade: np.ndarray, n_features: int,
                grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the ridge-penalised cumulative-logit likelihood.

    Thresholds are a base plus exponentials, so they stay ordered.  Classes are weighted
    inversely to the square root of their size.
    """
    lens = np.array([len(at) for at, _ in rows])
    at = np.concatenate([np.asarray(a, dtype=np.int64) for a, _ in rows]) if lens.sum() else np.zeros(0, np.int64)
    value = np.concatenate([np.log1p(np.asarray(v, dtype=float)) for _, v in rows]) if lens.sum() else np.zeros(0)
    owner = np.repeat(np.arange(len(rows)), lens)
    size = np.bincount(grade, minlength=grades + 1).clip(1)
    importance = np.sqrt(len(rows) / size)[grade]
    importance = importance / importance.sum()
    theta = np.concatenate([np.zeros(n_features), [1.0], np.zeros(grades - 1)])
    m, v2 = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, STEPS + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1:])
        cuts = theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, w[at] * value, len(rows))
        above = np.column_stack([np.ones(len(rows)), sigmoid(score[:, None] - cuts), np.zeros(len(rows))])
        i = np.arange(len(rows))
        hi, lo = above[i, grade], above[i, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        g_score = -importance * (d_hi - d_lo) / p
        g_cut = np.zeros(grades)
        np.add.at(g_cut, grade[grade > 0] - 1, (importance * d_hi / p)[grade > 0])
        np.add.at(g_cut, grade[grade < grades], -(importance * d_lo / p)[grade < grades])
        grad = np.concatenate([np.bincount(at, g_score[owner] * value, n_features) + RIDGE * w, [g_cut.sum()],
                               [g_cut[k + 1:].sum() * gaps[k] for k in range(grades - 1)]])
        m = 0.9 * m + 0.1 * grad
        v2 = 0.999 * v2 + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v2 / (1 - 0.999 ** step)) + 1e-9)
    gaps = np.exp(theta[n_features + 1:])
    return theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled rows, chosen by the hash of their id.

    Without labelled documents of both kinds the model is empty.  Rows with a NULL id, label
    or text are not used; of an id's repeated labels the largest holds.
    """
    chosen = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic"))
              .filter("__id IS NOT NULL AND __toxic IS NOT NULL").groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
              .orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))
    sample = written(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
                     .filter("text IS NOT NULL").join(chosen, "__id")
                     .select((F.col("__toxic") > 0).alias("toxic"), "text",
                             F.concat_ws(":", F.col("__id").cast("string"), F.md5("text")).alias("key")), "toxicity-sample")
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("toxic")).first()
    n, n_toxic = sizes["n"], sizes["toxic"]
    if not n_toxic or n_toxic == n:
        return OrdinalModel({}, [])
    share = n_toxic / n
    counts = (sample.select("toxic", "text").mapInArrow(_tally, "feature string, toxic bigint, n bigint")
              .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS))
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    own, spread = F.col("toxic") / F.col("n"), INTERVAL_Z ** 2 / F.col("n")
    least = (own + spread / 2 - INTERVAL_Z * F.sqrt((own * (1 - own) + spread / 4) / F.col("n"))) / (1 + spread)
    best = counts.withColumn("z", z).filter((F.col("z") >= MIN_Z) & (least >= MIN_SHARE)).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    features = {r["feature"]: i for i, r in enumerate(best)}
    vectors = sample.mapInArrow(_vectors(features), "toxic boolean, key string, at array<int>, value array<int>")
    # only selected features leave the tasks: a few numbers per sampled document
    rows = sorted(vectors.collect(), key=lambda r: r["key"])
    toxic = np.array([r["toxic"] for r in rows])
    amount = np.array([sum(r["value"]) for r in rows])
    cuts = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0).astype(np.int64)
    weights, thresholds = fit_ordinal([(r["at"], r["value"]) for r in rows], grade, len(features))
    return OrdinalModel({f: float(weights[i]) for f, i in features.items()}, [float(t) for t in thresholds])


def _score_batches(model: OrdinalModel):
    features = model.weights
    bases = {f.lstrip("23") for f in features}  # features of words that count towards one of the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}  # whether a word has a feature of the model
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                own: Counter = Counter()
                for w in _distinct_words(text):
                    hit = known.get(w)
                    if hit is None:
                        hit = any(f in bases for f in word_features(w))
                        if len(known) < CACHE_WORDS:
                            known[w] = hit
                    if hit:
                        own.update(f for f in word_features(w) if f in bases)
                scores.append(sum(features[f] * math.log1p(c) for f, c in sorted(with_repeats(own).items()) if f in features))
            ps = [model.probabilities(s) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns) if i != 1],
                 pa.array([sum(p) for p in ps], pa.float64()), pa.array([p[0] if p else 0.0 for p in ps], pa.float64())],
                names=[*[n for i, n in enumerate(batch.schema.names) if i != 1], "__severity", "__p_toxic"])

    return run


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, severity (expected grade, 0 to 3), p_toxic (P(grade >= 1)) and rejected.

    NULL and empty texts score like a text without words; repeated rows are scored one by
    one; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = slim.schema["__id"].dataType.simpleString()
    scored = slim.mapInArrow(_score_batches(model), f"__id {kind}, __severity double, __p_toxic double")
    return scored.select(F.col("__id").alias(id_col), F.col("__severity").alias("severity"),
                         F.col("__p_toxic").alias("p_toxic"), (F.col("__p_toxic") >= REJECT_FROM).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, same columns; one pass, no join."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    kept = docs.schema.names
    # under names of their own, whatever the columns are called; the text goes in twice, once to be
    # read and once to be carried along
    wide = docs.select(F.lit(0).alias("s0"), F.col(f"`{text_col}`").cast("string").alias("s1"),
                       *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(kept)])
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    scored = wide.mapInArrow(_score_batches(model), f"s0 int, {fields}, __severity double, __p_toxic double")
    return scored.filter(F.col("__p_toxic") < REJECT_FROM).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)])
