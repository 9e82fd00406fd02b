"""The Merkle manifest against a brute-force tree in plain Python."""

import hashlib
import zlib

import pytest
from cases import awkward_docs, empty_docs

from panelstats.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r):
    return h(*[enc(r[f]) for f in FIELDS])


def grow(level, arity):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def way(tree, i, arity):
    out = []
    for level in tree[:-1]:
        a = i // arity * arity
        out.append((level[a:i], level[i + 1:a + arity]))
        i //= arity
    return out


def report(rows, arity=3):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for s in sources}
    trees = {s: grow([leaf_of(r) for r in order[s]], arity) for s in sources}
    top = grow([trees[s][-1][0] for s in sources], arity) if sources else []
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            path = way(trees[s], i, arity) + way(top, j, arity)
            t = dict(r)
            if None not in (r["doc_id"], r["text"]) and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                t["text"] = r["text"].replace("\n", "")
            folded = leaf_of(t)
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], top[-1][0], h(*[x for b, a in path for x in b + a]),
                        folded, folded == top[-1][0]))
    return sorted(map(str, out))


def spark_report(docs, arity=3):
    return sorted(str(tuple(r)) for r in merkle.manifest_report(docs, arity).collect())


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_equals_a_tree_grown_by_hand(spark, arity):
    rows = [(i, f"line {i}\nand {i % 4}\n" if i % 5 else f"no feed {i}", "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}", i)
            for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = spark_report(docs, arity)
    assert got == report([r.asDict() for r in docs.collect()], arity)
    assert {r.endswith("True)") for r in got} == {True, False}


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    docs = awkward_docs(spark).withColumn("tree", merkle.F.lit("x")).withColumn("idx", merkle.F.lit(1)).withColumn("hash", merkle.F.lit(None))
    assert spark_report(docs) == report([r.asDict() for r in docs.collect()])


def test_empty_table_and_single_row(spark):
    assert merkle.manifest_report(empty_docs(spark)).count() == 0
    one = awkward_docs(spark).limit(1)
    (r,) = merkle.manifest_report(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")


def test_order_of_rows_and_partitions_does_not_matter(spark):
    docs = awkward_docs(spark)
    assert spark_report(docs) == spark_report(docs.orderBy(merkle.F.rand(3)).repartition(7))


def test_source_order_is_bytewise_with_null_first(spark):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["b", "B", "é", "\U0001f600", "￿", None, "", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert spark_report(docs) == report([r.asDict() for r in docs.collect()])
