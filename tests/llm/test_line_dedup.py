"""Line dedup against brute force; the deletion neighbourhood against edit distance."""

import random
import re
import sys
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import awkward_docs, empty_docs

from panelstats.llm import line_dedup as ld

SHORTEST, EDITED_FROM = 1, 8  # words of a line that can be a copy, and that can be a near line


def words_of(line):
    return [w for w in re.split(r"[ \t\r\x0b\x0c]+", line.lower()) if w]


WORDS = st.lists(st.sampled_from("abc"), min_size=8, max_size=12)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_neighbourhood_is_edit_distance_one(a, b):
    near = distance(a, b) <= 1
    assert ld.within_one_word(a, b) == near
    (ap, ad, aw), (bp, bd, bw) = ld.neighbourhood(a), ld.neighbourhood(b)
    if a != b:
        meet = (len(a) == len(b) and set(ap.tolist()) & set(bp.tolist())) or int(aw) in bd.tolist() or int(bw) in ad.tolist()
        assert bool(meet) == near


def one_edit(a, b):
    """Edit distance of one, by what is left between the common ends; for lines too long for
    the table of :func:`distance`."""
    if len(a) < 200 and len(b) < 200:
        return distance(a, b) == 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j == 1


def by_force(rows):
    """Kept lines of every (id, text), in the order of the rows."""
    lines = []
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            w = words_of(line)
            if len(w) >= SHORTEST:
                lines.append(((doc is None, doc or 0, no), tuple(w)))
    first = {}
    for at, w in lines:
        first[w] = min(first.get(w, at), at)
    near = {w for w in first if len(w) >= EDITED_FROM and any(
        first[v] < first[w] and min(len(v), len(w)) >= EDITED_FROM and v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w) for v in first)}
    out = []
    for doc, text in rows:
        kept, gone = [], 0
        for no, line in enumerate(text.split("\n")) if text is not None else ():
            w = tuple(words_of(line))
            if len(w) >= SHORTEST and (w in near or first[w] != (doc is None, doc or 0, no)):
                gone += 1
            else:
                kept.append(line)
        left = not gone or any(len(words_of(x)) >= SHORTEST for x in kept)
        out.append((doc, None if text is None else "\n".join(kept), left))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "q", 1, "w") for i, t in rows], "doc_id long, text string, k1 string, n int, line string")
    got = [(r.doc_id, r.text, r["__left"]) for r in ld.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(by_force(rows), key=str)
    left = sorted(((r.doc_id, r.text) for r in ld.drop_duplicate_lines(docs).collect()), key=str)
    assert left == sorted(((i, t) for i, t, x in by_force(rows) if x), key=str)


def test_random_corpus(spark):
    rng = random.Random(11)
    def line(n): return " ".join(rng.choice(["Aa", "b", "ç", "dd"]) for _ in range(n))  # noqa: E704
    pool = [line(rng.choice([1, 2, 3, 7, 8, 9, 10, 12])) for _ in range(60)]
    for p in list(pool):
        w = p.split(" ")
        k = rng.randrange(len(w))
        pool += [" ".join(w[:k] + w[k + 1:]), " ".join(w[:k] + ["new"] + w[k:]), " ".join(w[:k] + ["sub"] + w[k + 1:]), p.upper() + " \t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, rows[5][1]), (None, None), (80, ""), (81, None), (82, "\n\n \n")]
    check(spark, rows)


def test_hot_template_and_long_line(spark):
    """A thousand lines that differ in one place, and lines of many words."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, f"this is a template line with number {i} in it") for i in range(1000)]
    rows += [(2000, long), (2001, long + " more"), (2002, "x " + long), (2003, "y " + long + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in ld.drop_duplicate_lines(docs).collect()) == [0, 2000, 2003]


def test_short_lines_are_copies_and_keep_a_document(spark):
    """Copies of one and two words and of an unspaced paragraph go; a line of one word keeps its document."""
    para = "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u826f\u3044\u306e\u3067\u6563\u6b69\u3092\u3057\u307e\u3057\u305f\u3002" * 20
    rows = [(1, "les.\nand ornd.\n" + para), (2, "LES.\nfresh\n" + para), (3, "and  ornd.\n\n"), (4, "a line of five words"),
            (5, "a line of five words\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ld.drop_duplicate_lines(docs).collect()) == [
        (1, rows[0][1]), (2, "fresh"), (4, "a line of five words"), (5, "end")]
    assert sorted((r.doc_id, r.n_lines, r.n_copies, r.n_near, r.left) for r in ld.line_report(docs).collect()) == [
        (1, 3, 0, 0, True), (2, 3, 2, 0, True), (3, 3, 1, 0, False), (4, 1, 0, 0, True), (5, 2, 1, 0, True)]


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert ld.drop_duplicate_lines(docs).columns == docs.columns
    assert ld.drop_duplicate_lines(empty_docs(spark)).count() == 0 and ld.line_report(docs).count() == docs.count()


def test_half_keys_are_three_distinct_ones(spark):
    """Each line names the halves of its length and of one word less, none twice; the third half is
    chosen by the length instead of being found among four."""
    keys = ld._half_keys(F.col("ws"))
    lines = spark.createDataFrame([(n, [f"w{i}" for i in range(n)]) for n in range(1, 14)], "n int, ws array<string>")
    parts = [(n, side, [f"w{i}" for i in range(n)][:k // 2] if side == 0 else [f"w{i}" for i in range(n)][n - (k - k // 2):])
             for n in range(1, 14) for k in (n, n - 1) for side in (0, 1)]
    want = {}
    for r in spark.createDataFrame(parts, "n int, side int, w array<string>").select("n", "side", F.xxhash64("side", "w").alias("h")).collect():
        want.setdefault(r.n, set()).add((r.h, r.side))
    for r in lines.select("n", keys.alias("halves")).collect():
        if r.n < ld.EDIT_MIN_WORDS:
            assert r.halves is None
        else:
            assert len(r.halves) == 3 and {(h.h, h.side) for h in r.halves} == want[r.n]
    assert "array_distinct" not in str(keys)
