"""Ordinal regression: ordered thresholds, held-out accuracy, empty cases."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, empty_docs

from panelstats.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grade = [], []
    for _ in range(3000):
        counts = rng.poisson(0.5, 6)
        latent = counts @ np.array([2.0, 1.0, 0.5, 0, 0, -1.0]) + rng.logistic()
        grade.append(int(latent > 1) + int(latent > 3) + int(latent > 5))
        rows.append(([i for i in range(6) if counts[i]], [int(c) for c in counts if c]))
    w, t = tox.fit_ordinal(rows, np.array(grade), 6)
    assert (np.diff(t) > 0).all() and w[0] > w[1] > w[2] > w[5] and abs(w[3]) < w[2]


@pytest.mark.parametrize("side", [0, 1])
def test_held_out_accuracy(spark, side):
    """Fitted on some 2,000 labels, judged on the others.  One toxic document in 25 has none of the
    vocabulary (repeated or shouted junk that is labelled toxic)."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == side
    model = tox.fit_toxicity(docs, labels.filter(half))
    got = tox.score_toxicity(docs, model).join(labels.filter(~half), "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.rejected.mean() > 0.9 and clean.rejected.mean() < 0.005
    assert got.severity.between(0, 3).all() and toxic.severity.mean() > clean.severity.mean() + 1.2


def test_fit_equals_a_plain_optimiser():
    """The fitted likelihood against that of the same model found by plain gradient descent."""
    rng = np.random.default_rng(5)
    x = rng.poisson(0.7, (400, 3)).astype(float)
    grade = np.clip(np.round(np.log1p(x) @ np.array([1.5, -1.0, 0.0]) + rng.normal(size=400)), 0, 3).astype(np.int64)
    rows = [([i for i in range(3) if r[i]], [int(v) for v in r if v]) for r in x]
    w, t = tox.fit_ordinal(rows, grade, 3)
    size = np.bincount(grade, minlength=4).clip(1)
    share = np.sqrt(400 / size)[grade]
    share /= share.sum()

    def loss(p):
        s = np.log1p(x) @ p[:3]
        cuts = p[3] + np.concatenate([[0.0], np.cumsum(np.exp(p[4:]))])
        above = np.column_stack([np.ones(400), 1 / (1 + np.exp(-(s[:, None] - cuts))), np.zeros(400)])
        i = np.arange(400)
        return -(share * np.log(np.maximum(above[i, grade] - above[i, grade + 1], 1e-12))).sum() + tox.RIDGE / 2 * (p[:3] ** 2).sum()

    p = np.array([0.0, 0.0, 0.0, 1.0, 0.0, 0.0])
    for _ in range(4000):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(6) * 1e-5])
        p -= 0.5 * g
    mine = np.concatenate([w, [t[0]], np.log(np.diff(t))])
    assert loss(mine) <= loss(p) + 1e-4


def test_columns_of_any_name(spark):
    docs = awkward_docs(spark).limit(5)
    for name in ("__0", "__text", "__p_toxic", "s0", "c0", "odd`name"):
        docs = docs.withColumn(name, F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert tox.drop_toxic(docs, labels).columns == docs.columns and tox.drop_toxic(docs, labels.limit(0)).count() == 5


def test_drop_equals_score(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = tox.drop_toxic(docs, labels)
    scored = tox.score_toxicity(docs, tox.fit_toxicity(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(kept.collect()) == sorted(docs.join(scored.filter("NOT rejected"), "doc_id", "left_semi").collect())


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (7, 0), (None, 1), (9, None), (99, 1)], "doc_id long, toxic int")
    assert tox.score_toxicity(docs, tox.fit_toxicity(docs, labels)).count() == docs.count()
    assert tox.drop_toxic(docs, labels).columns == docs.columns
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert tox.drop_toxic(docs, none).count() == docs.count()  # no model rejects nothing
    assert tox.score_toxicity(empty_docs(spark), tox.fit_toxicity(docs, labels)).count() == 0
