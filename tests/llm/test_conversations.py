"""Conversation repair against a search over all cheap edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

from panelstats.llm import conversations as C

GOOD = re.compile(r"(s?(ua)+)?")


def edits_by_force(rows, limit):
    """Least (cost, audit, repaired lines) by trying every sequence of edits up to a cost."""
    best = None

    def go(i, cost, audit, lines):
        nonlocal best
        if cost > (limit if best is None else best[0]):
            return
        if i == len(rows) and GOOD.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, [f"{r}:{t}" for r, t in lines])
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", lines + [(role, "")])
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            go(i + 1, cost + 2, audit + "D", lines)
            if not must_go:
                extra = 5 if truncated else 0
                go(i + 1, cost + extra, audit + "K", lines + [(role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", lines + [(other, text)])

    go(0, 0, "", [])
    return best


def faults(rows):
    """Sorted (turn, role, text) rows with their first fault, by plain definition."""
    seen, out = set(), []
    for turn, role, text in rows:
        real = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        role = "user" if code == 4 else role
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        for _ in range(2 if code == 3 else 1):
            yield conv, turn, role, text


def report_by_force(rows):
    out = {}
    broken = list(damage(rows))
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r, x) for c, t, r, x in broken if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged = faults(mine)
        cost, audit, lines = edits_by_force([(r, t, f in ("blank", "duplicate"), f == "truncated") for _, r, t, f in judged], 2 * len(mine))
        turns = {t for t, _, _ in mine if t is not None}
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for *_, f in judged) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def spark_report(df):
    return {r[0]: tuple(r)[1:] for r in C.conversation_report(df).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_search_over_all_edits(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "And then", "", " \n", "Why?", "Well. ", "a "]
    rows = [(c, rng.choice([i, i, i, None, i + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(texts + [None])) for c in range(60) for i in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes.")] + rows[:7]
    assert spark_report(spark.createDataFrame(rows, SCHEMA).repartition(5)) == report_by_force(rows)


def by_plain_strings(rows):
    """The same programme with whole strings as audits."""
    best = {0: (0, "")}

    def inserts(b):
        for _ in range(4):
            for s, (c, a) in list(b.items()):
                t = C.NEXT[s][0]
                b[t] = min(b.get(t, (10**9, "")), (c + 5, a + "I"))
        return b

    for role, _, must_go, truncated in rows:
        new = {}
        for s, (c, a) in inserts(best).items():
            options = [(s, c + 2, a + "D")]
            if not must_go:
                x = 5 * truncated
                options += [(C.NEXT[s][0], c + 1 + x, a + "R")] + [(C.FOLLOWS[s].get(role[:1]), c + x, a + "K")] * (role[:1] in C.FOLLOWS[s])
            for t, cost, audit in options:
                new[t] = min(new.get(t, (10**9, "")), (cost, audit))
        best = new
    return min(v for s, v in inserts(best).items() if s in C.ENDS)


def test_long_conversations_compaction_and_colliding_hashes():
    rng = random.Random(9)
    for n, roles, compact_at, mod in itertools.product((3, 40, 700), (["system"], ["user"], ["user", "assistant", "system", "x"]), (8, 4096), ((1 << 61) - 1, 3)):
        rows = [(rng.choice(roles), str(i), rng.random() < 0.1, rng.random() < 0.2) for i in range(n)]
        repair = C.Repair(compact_at)
        repair.nodes = C.Audits(mod=mod)
        for r in rows:
            repair.row(*r)
        assert repair.result()[:2] == by_plain_strings(rows)


def test_persistent_audits_compare_as_texts():
    rng = random.Random(2)
    for mod in ((1 << 61) - 1, 2):  # with two hash values nearly all prefixes collide
        nodes = C.Audits(mod=mod)
        known = {0: ""}
        for _ in range(400):
            parent = rng.choice(list(known))
            letter = rng.choice("DK")
            known[nodes.add(parent, letter)] = known[parent] + letter
        assert len(set(known.values())) == len(known)
        for a, b in itertools.product(rng.sample(list(known), 40), repeat=2):
            assert nodes.less(a, b) == (known[a] < known[b])
            assert nodes.text(a) == known[a]


def test_memory_follows_the_undecided_part():
    repair = C.Repair(compact_at=64)
    for i in range(20_000):
        repair.row("user" if i % 2 == 0 else "assistant", f"{i}.", False, False)
        assert len(repair.nodes) <= 200
    assert repair.result()[:2] == (0, "K" * 20_000)


def test_empty_table_long_texts_and_clashing_names(spark):
    assert C.conversation_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "x" * 1_000_000), (2, 0, "user", ""), (3, 0, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("real", "copy", "code", "fault", "nth", "no_conv", "audit"):
        df = df.withColumn(name, C.F.lit("z"))
    assert spark_report(df) == report_by_force(rows)


def test_a_conversation_goes_on_over_batches(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        (got,) = C.conversation_report(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    judged = faults(sorted((t, r, x) for _, t, r, x in damage(rows)))
    cost, audit = by_plain_strings([(r, t, f in ("blank", "duplicate"), f == "truncated") for _, r, t, f in judged])
    assert (got["cost"], got["audit"]) == (cost, audit)
