"""ProbMinHash estimates, components, classes against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, classes_by_force, empty_docs, probability_jaccard

from panelstats.llm import minhash as mh
from panelstats.llm.components import connected_components


def test_signature_estimates_probability_jaccard():
    rng = random.Random(4)
    for n, m in ((3, 2), (40, 30), (400, 300)):
        x = {k + 1: rng.choice([1, 1, 2, 5]) for k in range(n)}
        y = {k + 1: rng.choice([1, 2, x.get(k + 1, 1)]) for k in range(n - m, 2 * n - m)}
        agree = []
        for salt in range(40):
            sign = lambda z: mh.signature(mh.mix64(np.array(sorted(z), np.uint64) + np.uint64(salt * 10 ** 6)),
                                          np.array([z[k] for k in sorted(z)]))
            agree.append((sign(x) == sign(y)).mean())
        rate = lambda z: {k: 1 + np.log(v) for k, v in z.items()}
        assert abs(np.mean(agree) - probability_jaccard(rate(x), rate(y))) < 0.04


def test_signature_does_not_depend_on_order_or_company():
    s = mh.mix64(np.arange(1, 500, dtype=np.uint64))
    c = np.ones(499, np.int64)
    a, p = mh.signature(s, c), np.random.default_rng(0).permutation(499)
    assert (a == mh.signature(s[p], c)).all()
    more = mh.signature(np.concatenate([s, mh.mix64(np.arange(5000, 5100, dtype=np.uint64))]), np.ones(599, np.int64))
    assert set(more.tolist()) - set(s.tolist()) and (more[np.isin(more, s)] == a[np.isin(more, s)]).all()


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 400)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)]
    got = {r.key: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def corpus():
    """Chains, hubs and clean texts, and a passage that many share."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, shared = {}, " ".join(word() for _ in range(40))
    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = word()
        return " ".join(w)
    for i in range(60):
        texts[len(texts)] = " ".join(word() for _ in range(rng.choice([4, 30, 120, 200]))) + (" " + shared if i % 3 == 0 else "")
    for i in range(40):
        hub = texts[i]
        for n in (0, 1, 2, 4):
            if len(hub.split()) > 100:
                texts[len(texts)] = edit(hub, n)
    hub = " ".join(word() for _ in range(150))
    for _ in range(60):
        texts[len(texts)] = edit(hub, 3)
    chain = hub
    for _ in range(12):
        chain = edit(chain, 2)
        texts[len(texts)] = chain
    for k in range(4):
        texts[len(texts)] = hub if k % 2 else hub.upper() + "!"
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in mh.near_duplicates(docs).collect()}
    assert got == classes_by_force(texts)
    left = sorted(r.doc_id for r in mh.drop_near_duplicates(docs).collect())
    assert left == sorted(set(got.values()))


def test_pairs_led_by_a_third_text(spark):
    """A family around the threshold: its texts share buckets with most others but are linked to
    some of them only, so that many pairs are led by a third text below the threshold."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, base = {}, [word() for _ in range(200)]
    for _ in range(120):
        own = list(base)
        for n in (3, 4):
            for k in rng.sample(range(200), n):
                own[k] = word()
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in mh.near_duplicates(docs).collect()}
    assert got == classes_by_force(texts)


def test_repeated_passages_weigh(spark):
    """Texts of which one repeats a passage: near copies or not by the weights, as by force."""
    rng = random.Random(5)
    texts = {}
    for k in range(40):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(204)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join(w[:150] + w[106:150] * (1 + k % 8) + w[150:])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in mh.near_duplicates(docs).collect()}
    want = classes_by_force(texts)
    assert got == want and 0 < sum(i != c for i, c in want.items()) < 40


def test_similarity_equals_its_definition():
    rng = random.Random(2)
    for _ in range(60):
        x = {rng.randrange(30): rng.choice([1, 1, 2, 9]) for _ in range(rng.randrange(1, 25))}
        y = {rng.randrange(30): rng.choice([1, 1, 3]) for _ in range(rng.randrange(1, 25))}
        sides = [(np.array(sorted(z), np.uint64), np.array([z[k] for k in sorted(z)])) for z in (x, y)]
        weights = [{k: 1 + np.log(c) for k, c in z.items()} for z in (x, y)]
        assert abs(mh.probability_jaccard(*sides[0], *sides[1]) - probability_jaccard(*weights)) < 1e-9


def test_signatures_keep_pairs_at_the_threshold():
    """Of pairs barely above the threshold, both signature filters lose next to none."""
    rng, lost = np.random.default_rng(7), 0
    for _ in range(300):
        s = mh.mix64(rng.integers(1, 1 << 62, 220).astype(np.uint64))
        a, b = np.sort(s[:198]), np.sort(s[22:])   # Jaccard 176 / 220
        ones = np.ones(198, np.int64)
        assert mh.probability_jaccard(a, ones, b, ones) == 0.8
        x, y = (np.frombuffer(mh.fine_sketch(z, ones), np.uint8) for z in (a, b))
        d = x ^ y
        fine = ((d & 15) == 0).sum() + ((d & 240) == 0).sum()
        p, q = (mh.signature(z, ones) for z in (a, b))
        lost += fine < mh.FINE_AGREE or (p == q).sum() < mh.MIN_AGREE or not (mh.band_keys(p) == mh.band_keys(q)).any()
    assert lost <= 1


def test_last_round_emits_no_pairs_of_a_family_below_the_threshold(spark):
    """A family whose members are alike at 0.65: they share buckets, but no pair is written."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(200)], {}
    for i in range(300):
        own = list(base)
        for k in rng.sample(range(200), 5):
            own[k] = word()
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = []
    real = mh._remaining
    try:
        mh._remaining = lambda *a: found.append(real(*a).count()) or real(*a)
        got = {r.doc_id: r.class_id for r in mh.near_duplicates(docs).collect()}
    finally:
        mh._remaining = real
    assert got == classes_by_force(texts) and found[0] < 3000  # of 45,000 pairs


def test_last_round_writes_links_only(spark):
    """Texts alike at 0.73 pass the signatures; the blocks verify them and write links only, at most
    one for every class that is joined."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(200)], {}
    for i in range(200):
        own = list(base)
        for k in rng.sample(range(200), 3):
            own[k] = word()
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found, real = [], mh._remaining
    try:
        mh._remaining = lambda *a: found.append(real(*a).count()) or real(*a)
        got = {r.doc_id: r.class_id for r in mh.near_duplicates(docs).collect()}
    finally:
        mh._remaining = real
    assert got == classes_by_force(texts) and found[0] < 200  # of 19,900 pairs


def test_equal_rows_but_for_another_column_stay_once(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", s) for s in ("b", "a", None, "c")], "doc_id long, text string, source string")
    for order in (1, 2):
        assert [r.source for r in mh.drop_near_duplicates(docs.orderBy(F.rand(order))).collect()] == ["a"]


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    rows = mh.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (None, 2)}
    assert by_id[8].class_id == 7 and by_id[3].class_id == 1 and by_id[6].kept and by_id[5].kept and by_id[4].kept
    assert sum(r.kept for r in rows if r.class_id == 1) == 2  # a repeated row is kept as often as it is there
    left = mh.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 4, 5, 6, 7, 9, 10] and ids.count(None) == 1
    assert mh.near_duplicates(empty_docs(spark)).count() == 0 and mh.drop_near_duplicates(empty_docs(spark)).count() == 0
