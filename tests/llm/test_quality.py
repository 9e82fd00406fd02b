"""Quality counts by brute force, EM, held-out agreement with the labels."""

import random
import re
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, empty_docs

from panelstats.llm import quality


def by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts():
    rng = random.Random(3)
    texts = ["", None, "a", "\x1c\x85   x\x0by\x0cz\r\n", "a b " * 40, "line\nline\n \n \nline", "é# 😀|x <> " * 9]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["\n".join(" ".join(rng.choice(["x", "yy", "z#"]) for _ in range(rng.randrange(12))) for _ in range(9)) for _ in range(50)]
    for t in texts:
        assert quality.text_stats(t)[:5] == by_force(t), t


def simulated(rng, n, share, rates):
    """Votes of rules with their own (P(-1), P(+1)) on bad and on good documents."""
    good = rng.random(n) < share
    votes = []
    for bad_rates, good_rates in rates:
        minus, plus = np.where(good, good_rates[0], bad_rates[0]), np.where(good, good_rates[1], bad_rates[1])
        u = rng.random(n)
        votes.append(np.where(u < minus, -1, np.where(u < minus + plus, 1, 0)))
    votes = np.stack(votes, 1)
    patterns, of, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return good, votes, [(tuple(p), int(c)) for p, c in zip(patterns, count)], patterns, of.ravel()


def verdicts(evidence, share, patterns):
    return np.log(share / (1 - share)) + np.array([sum(evidence[r][v + 1] for r, v in enumerate(p)) for p in patterns]) >= 0


def test_em_recovers_rates_of_each_class():
    rng = np.random.default_rng(1)
    rates = [((0.9, 0.05), (0.1, 0.8)), ((0.7, 0.1), (0.02, 0.6)), ((0.8, 0.0), (0.05, 0.0)), ((0.3, 0.1), (0.1, 0.7))]
    good, votes, counted, patterns, of = simulated(rng, 40_000, 0.7, rates)
    evidence, share = quality.fit_rules(counted)
    assert abs(share - 0.7) < 0.03
    for r, ((bm, bp), (gm, gp)) in enumerate(rates):
        assert abs(evidence[r][0] - np.log(gm / bm)) < 0.35
        if bp:
            assert abs(evidence[r][2] - np.log(gp / bp)) < 0.35
    assert quality.fit_rules([])[0].size == 0


def test_em_beats_the_sum_of_votes():
    """Some rules are nearly blind or right about one class only: the sum counts them like the others."""
    rng = np.random.default_rng(4)
    rates = [((0.95, 0.01), (0.02, 0.9)), ((0.9, 0.0), (0.01, 0.0)), ((0.85, 0.05), (0.05, 0.8))] + [((0.30, 0.25), (0.25, 0.30))] * 4
    good, votes, counted, patterns, of = simulated(rng, 30_000, 0.75, rates)
    ours = verdicts(*quality.fit_rules(counted), patterns)[of] == good
    by_sum = (votes.sum(axis=1) >= 0) == good
    all_pass = (votes >= 0).all(axis=1) == good
    assert ours.mean() > 0.98 and ours.mean() > by_sum.mean() + 0.03 and ours.mean() > all_pass.mean() + 0.2


def test_rows(spark):
    docs = awkward_docs(spark)
    got = quality.judge_quality(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert sorted(map(str, ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(
        str(by_force(r.text)) for r in docs.collect())
    assert quality.judge_quality(empty_docs(spark)).count() == 0


def test_agrees_with_labels(spark):
    """Labels play no part in the fit, so all of them are held out."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = (quality.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "kept", "base_failed")
              .join(labels, "doc_id").toPandas())
    good, poor = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.98 and poor.kept.mean() < 0.05
