"""Pfair schedule: deviation, whole results, agreement with a simulated schedule."""

import heapq
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, empty_docs

from oracle_check import compare, duck
from panelstats.llm import mixing, oracle, queries


def simulate(shares):
    """Earliest deadline first with release times, slot by slot."""
    total, out, waiting = sum(shares), [], []
    blocks = sorted((k * total // q, -(-(k + 1) * total // q), j, k) for j, q in enumerate(shares) for k in range(q))
    at = 0
    for slot in range(total):
        while at < len(blocks) and blocks[at][0] <= slot:
            heapq.heappush(waiting, blocks[at][1:])
            at += 1
        deadline, j, k = heapq.heappop(waiting)
        assert deadline >= slot + 1
        out.append((slot, j, k))
    return out


@pytest.mark.parametrize("shares", [[1], [5, 3, 2], [7, 1, 1, 1], [50, *[1] * 50], [13, 11, 9, 8, 4, 2, 1],
                                    [3] * 700, [1 + (i * 7919) % 23 for i in range(400)]])
def test_period_equals_simulation(spark, shares):
    table = spark.createDataFrame([(f"s{j:04d}", 10, q) for j, q in enumerate(shares)], "source string, n long, q int")
    got = sorted((r.slot, r.j, r.k) for r in mixing.pfair_period(table).collect())
    assert got == simulate(shares)
    done = [0] * len(shares)
    for slot, j, _ in got:
        done[j] += 1
        assert all(abs(d - q * (slot + 1) / sum(shares)) < 1 for d, q in zip(done, shares))


def test_documents_deviate_less_than_a_block(spark):
    rows = [(i, ["big", "mid", "small"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted(mixing.mix(docs, weights={"big": 2, "mid": 2, "small": 1}, block_docs=8).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(2000)) and sorted(r.doc_id for r in got) == list(range(2000))
    seen = {"big": 0, "mid": 0, "small": 0}
    weight = {"big": 0.4, "mid": 0.4, "small": 0.2}
    for n, r in enumerate(got, 1):
        seen[r.source] += 1
        if max(seen["mid"] / 600, seen["small"] / 200) < 1:  # all sources still have documents
            assert all(abs(seen[s] - weight[s] * n) < 8 + 1e-9 for s in seen)
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"big": 0})


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = mixing.mix(docs)
    assert got.columns == docs.columns + ["mix_block", "mix_slot", "mix_position"]
    rows = got.collect()
    assert sorted(r.mix_position for r in rows) == list(range(docs.count()))
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.mix(got).columns == got.columns  # its own columns are replaced


@pytest.mark.parametrize("key", ["op2_mixing", "op4_decontamination"])
def test_sql(spark, key):
    problems, _ = compare(spark, duck("/root/testdata/sf0.01"), queries.QUERIES[key], oracle.ORACLE[key], "/root/testdata/sf0.01")
    assert not problems
