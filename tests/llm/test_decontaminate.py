"""Benchmark windows: brute force over awkward texts and short items."""

import hashlib
import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, empty_docs

from panelstats.llm import decontaminate as dec

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def by_force(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        ids = ",".join(sorted(str(x) for x in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, win string, n_hit int")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, items string")
    got = [tuple(r)[:6] for r in dec.find_hits(d, b).collect()]
    assert sorted(got, key=str) == by_force(docs, items)
    left = sorted((r.doc_id, r.text) for r in dec.decontaminate(d, b).collect())
    bad = {t for (i, t) in docs if by_force([(i, t)], items)[0][5]}
    assert left == sorted((i, t) for i, t in docs if t not in bad)


def test_random_texts(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "C", "ÄB", "d9", "é", "F-f"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(2, 14)] + [(20, None), (21, "..."), (2, text(12))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, text(5) + ", " + (t or "") + "; " + text(4)) for i, t in items]
    items = [x for x in items if len(words(x[1])) not in (1, 3)] + [(30, "qq d9 b"), (31, "zz")]
    check(spark, docs + [(500, "x qq  D9.b zz"), (500, "x qq  D9.b zz")], items)


def test_separators_and_nul(spark):
    chars = "".join(chr(c) for c in range(256)) + "\u2028\U0001f600"
    check(spark, [(1, "x".join(chars)), (2, chars * 3), (3, "one\x00two\x00three")], [(1, "one two three"), (2, "x é x")])


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "tail"), (3, None)],
                                  "item_id long, text string")
    got = dec.find_hits(docs, items).collect()
    assert len(got) == docs.count() and sum(r.contaminated for r in got) == 6
    assert dec.decontaminate(docs, items).columns == docs.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dec.find_hits(docs, none).collect())
    assert dec.decontaminate(docs, none).count() == docs.count()
    assert dec.find_hits(empty_docs(spark), items).count() == 0


def test_full_filter_stays_exact(spark):
    """A Bloom filter far too small passes everything on to the exact join."""
    docs, items = [(1, "a b c d e f g h i j k"), (2, "a b c")], [(1, "b c d e f g h i j k"), (2, "x y")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.n_hit for r in dec.find_hits(d, b, filter_bits=6).collect()) == [0, 10]


def test_filter_grows_with_the_benchmark(spark):
    """The filter's size follows the counted runs, and clean texts leave it unmarked."""
    assert dec.filter_bits_for(1) == dec.MIN_BITS and dec.filter_bits_for(1 << 40) == dec.MAX_BITS
    assert dec.filter_bits_for(50_000) == 20
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    items = spark.createDataFrame([(i, text(200)) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, text(400)) for i in range(50)] + [(99, items.first().text)], "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in dec.find_hits(docs, items).collect()}
    assert got == {**{i: 0 for i in range(50)}, 99: 200}
