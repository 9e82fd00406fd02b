"""Quality rules under weak supervision.

Every rule votes good (+1), bad (-1) or abstains (0) on a document, each on evidence of its own
(rules that read the same counts are one rule, so that no evidence counts twice).  A document's
votes form a pattern; the patterns' counts over the whole corpus (at most 3 ** rules rows, however
large the corpus) are all that expectation-maximisation needs to estimate how often each rule
votes each way on good and on bad documents, apart, and the share of good documents.  The
posterior probability of being good then decides, in place of demanding that every rule passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import written

# Fixed values of the contract: words are runs of anything but these; symbols; window.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

KEEP_FROM = 0.5          # posterior probability of good quality from which a document stays
ITERATIONS = 200
# A vote is taken to be right with this probability before anything is learned, with the weight of
# so many imagined documents, a share of them good.
START_ACCURACY, START_VOTES, START_GOOD = 0.8, 20.0, 0.8
MAX_EVIDENCE, MAX_SILENCE = 4.6, 0.5   # log-odds that one vote, or abstaining, gives at most

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_upper", "n_lower", "n_exclaim", "n_stops", "n_same", "n_short", "n_distinct", "entropy")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) | 1 for k in range(WINDOW)], dtype=object)
_MULTIPLIERS = (_MULTIPLIERS % (1 << 64)).astype(np.uint64)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found twice or more, the first included.

    A hash of every run rules out texts without repeats (equal runs hash alike); the others
    are counted exactly, by ranks of runs of doubled length.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    runs = h[:n] * _MULTIPLIERS[0]
    for k in range(1, window):
        runs = runs + h[k:k + n] * _MULTIPLIERS[k]
    runs.sort()
    if not (runs[1:] == runs[:-1]).any():
        return 0
    numbers: dict = {}
    rank = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    step = 1
    while step < window:  # window is a power of two
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in ``STATS`` of one whole text; NULL counts as empty.  Short words have at
    most three bytes, the entropy is that of the bytes, in thousandths of a bit."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly the six characters of WHITE
    seen: set = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup,
            repeated_words(words), lines, len(raw) - len(raw.translate(None, _UPPER)),
            len(raw) - len(raw.translate(None, _LOWER)), text.count("!"), text.count("."), sum(map(eq, words, words[1:])),
            sum(len(w) < 4 for w in words), len(set(words)), byte_entropy(raw))


def byte_entropy(raw: bytes) -> int:
    """Entropy of the bytes, letters A-Z as a-z, in thousandths of a bit."""
    n = np.bincount(np.frombuffer(raw.lower(), np.uint8), minlength=256)
    share = n[n > 0] / max(1, len(raw))
    return int(round(-1000 * float((share * np.log2(share)).sum())))


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_stats(t) for t in batch.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(STATS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["id", *STATS])


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the counts of ``STATS`` for every row, over whole texts."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_stats_batches, f"id {kind}, " + ", ".join(f"{s} bigint" for s in STATS))


def _vote(bad: Column, good: Column | None = None) -> Column:
    out = F.when(bad, -1)
    return (out if good is None else out.when(good, 1)).otherwise(0).cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules over the columns of ``STATS``: good (+1), bad (-1), abstain (0).

    Not to break a rule says little, so most rules only ever vote bad; those that vote good
    ask for a sign of plain prose.
    """
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    letters = F.col("n_upper") + F.col("n_lower")
    mean, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    marks = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    stops, upper = F.col("n_stops") / words, F.col("n_upper") / F.greatest(letters, F.lit(1)).cast("double")
    dups = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    short = F.col("n_short") / words
    many = F.col("n_words") >= MIN_WORDS
    return {
        "length": _vote(~many),
        "word_length": _vote((mean < 2) | (mean > 20)),
        "symbols": _vote((symbols > 0.3) | (marks > 0.05), (symbols <= 0.05) & (marks <= 0.01)),
        "upper_case": _vote((upper > 0.6) & (letters > 20)),
        "exclaims": _vote(F.col("n_exclaim") / words > 0.3),
        "dup_lines": _vote((dups > 0.5) & (F.col("n_lines") > 3)),
        "repeats": _vote(F.col("n_repeat_words") / words > 0.3),
        "stutter": _vote(F.col("n_same") / words > 0.3),
        "sentences": _vote(stops > 1.0, stops.between(0.01, 0.34)),
        "function_words": _vote(many & ((short < 0.12) | (short > 0.48)), short.between(0.22, 0.44)),
        "variety": _vote(many & (F.col("n_distinct") / F.pow(words, F.lit(0.75)) < 1.5)),
        "entropy": _vote(many & ((F.col("entropy") < 3500) | (F.col("entropy") > 4900))),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """(evidence, share of good) from (votes, count) rows, by EM.

    ``evidence[rule]`` has the log-odds of good that the votes -1, 0 and +1 give.  Given a document's
    class, rules vote independently, each with its own rates on good and on bad documents (so a
    rule may be right about bad documents only).  A vote never speaks against itself, none
    decides alone, and abstaining says little.
    """
    patterns = sorted(patterns)
    n_rules = len(patterns[0][0]) if patterns else 0
    if not patterns:
        return np.zeros((0, 3)), START_GOOD
    vote = np.array([p for p, _ in patterns], dtype=int)
    count = np.array([c for _, c in patterns], dtype=float)
    cast = np.stack([(vote == v) for v in (-1, 0, 1)], axis=2).astype(float)      # patterns x rules x votes
    rate = np.einsum("p,prv->rv", count, cast) / count.sum()
    right = np.array([1 - START_ACCURACY, START_GOOD, START_ACCURACY])             # P(good | vote), before learning
    prior = np.stack([rate * (1 - right) / (1 - START_GOOD), rate * right / START_GOOD])  # class x rules x votes
    prior = (prior + 1e-3) / (prior + 1e-3).sum(axis=2, keepdims=True)
    weight = START_VOTES * np.array([1 - START_GOOD, START_GOOD])
    theta, good = prior, START_GOOD
    limits = np.array([[-MAX_EVIDENCE, -0.02], [-MAX_SILENCE, MAX_SILENCE], [0.02, MAX_EVIDENCE]])
    evidence = np.zeros((n_rules, 3))
    for _ in range(iterations):
        new = np.clip(np.log(theta[1]) - np.log(theta[0]), limits[:, 0], limits[:, 1])
        logit = math.log(good / (1 - good)) + np.einsum("prv,rv->p", cast, new)
        post = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        both = np.stack([(1 - post) * count, post * count])
        seen = np.einsum("cp,prv->crv", both, cast)
        theta = (seen + weight[:, None, None] * prior) / (both.sum(axis=1) + weight)[:, None, None]
        share = float(np.clip(post @ count / count.sum(), 0.01, 0.99))
        done = np.abs(new - evidence).max() < 1e-10 and abs(share - good) < 1e-10
        evidence, good = new, share
        if done:
            break
    return evidence, good


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, posterior and verdict of every row.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality (posterior probability of good).  NULL and empty texts have no
    words, so they fail the base rules; repeated rows and ids are judged one by one; other
    columns are ignored; an empty table gives an empty result.
    """
    rules = votes()
    stats = written(document_stats(docs, id_col=id_col, text_col=text_col).withColumns(
        {f"v_{name}": rule for name, rule in rules.items()}), "quality-stats")
    cols = [f"v_{name}" for name in rules]
    patterns = [(tuple(r[c] for c in cols), r["n"])
                for r in stats.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()]  # <= 3 ** rules rows
    evidence, good = fit_rules(patterns)
    logit = F.lit(math.log(good / (1 - good)))
    for name, (bad, none, fine) in zip(cols, evidence.tolist()):
        logit = logit + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, fine).otherwise(none)
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select(F.col("id").alias(id_col), *STATS[:5], failed.alias("base_failed"),
                        (~failed & (quality >= KEEP_FROM)).alias("kept"), quality.alias("quality"))
