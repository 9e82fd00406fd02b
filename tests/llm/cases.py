"""Small tables with the cases every operator has to bear, and brute-force helpers."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept int, key string"


def awkward_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows and ids, extra columns
    whose names the operators use themselves."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [
        (1, base, "en", "a", len(base), "x", 1, "k"),
        (1, base, "en", "a", len(base), "x", 1, "k"),
        (2, base + "\n" + base, None, "a", None, None, None, None),
        (3, base.upper() + " phi", "en", None, 5, "", 0, ""),
        (None, base, "en", "b", 1, None, None, None),
        (None, None, None, None, None, None, None, None),
        (4, None, "en", "b", 0, "y", 2, "k"),
        (5, "", "en", "b", 0, "y", 2, "k"),
        (6, " \t\n\n ", "en", "b", 0, "y", 2, "k"),
        (7, long, "en", "c", len(long), "y", 2, "k"),
        (8, long + " tail", "en", "c", len(long), "y", 2, "k"),
        (9, "\x00Ünï\u00a0cödé\u2003straße\U0001f600 ǅ", "de", "c", 9, "y", 2, "k"),
        (10, "one", "en", "d", 3, "y", 2, "k"),
        (2, "another text under the id two with quite a few words of its own kind", "en", "d", 3, "y", 2, "k"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def shingles(text, n=5):
    """Five-word shingles with their weights."""
    w = re.findall(r"\w+", (text or "").lower())
    found = Counter(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else {}
    return {k: 1 + math.log(c) for k, c in found.items()}


def probability_jaccard(x, y):
    """By definition; with equal weights the Jaccard similarity."""
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    if set(x.values()) == set(y.values()) == {1.0}:
        return len(both) / (len(x) + len(y) - len(both))
    every = list(x.keys() | y.keys())
    a, b = (np.array([z.get(k, 0.0) for k in every]) for z in (x, y))
    return sum(1 / np.maximum(a / x[i], b / y[i]).sum() for i in both)


def classes_by_force(texts: dict, threshold=0.8) -> dict:
    """Least id of every id's class, by comparing all pairs."""
    own = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b] and probability_jaccard(own[a], own[b]) >= threshold - 1e-12:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
