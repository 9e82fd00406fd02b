"""Structure repair of conversations: the cheapest edits that give ``(system? (user assistant)+)?``.

A conversation's rows are read in order by a dynamic programme over the last role kept (none,
system, user, assistant).  Its audits - one letter per edit - are kept persistently: a node is a
letter on top of a parent node, so the four live audits share their prefixes, and a row adds a
few nodes instead of copying texts.  Every node knows the rolling hash of its whole audit and
its ancestors 1, 2, 4, ... steps up.  Of two equally cheap audits the ASCII-least wins: the
longest common prefix is found by descending the ancestors with the hashes, and is verified by
identity, for nodes are interned and equal audits are one node.  (Two such audits never are
prefixes of one another: the longer one would only add insertions, which cost.)

A state that another one undercuts whatever follows is dropped (strictly, so no tie is lost).
Whenever the arrays have doubled, branches that no live audit uses are dropped and the prefix
that all live audits share is written out, so a long conversation holds its undecided part.
Every live audit also carries the running hash of its repaired text, so texts are read once and
never held.

Spark: one shuffle by conversation; a window marks rows whose role and text came before (in
conversations of any length it spills, as the sort does); the sorted rows are streamed through
``mapInPandas`` in batches.  The digest of a repaired conversation is one SHA-256 over it, so a
conversation is one stream by definition; what a task holds of it is the audit and its undecided
part, never its texts.

Defined cases: NULL roles and texts count as one space, a NULL turn comes first, a NULL
conversation id is a conversation of its own; a row with an empty role has no initial and
cannot be kept as it is.  Rows of equal turns are ordered by role, then
text, wholly equal rows are told apart by nothing.  An empty table gives no rows.  Columns that
are not named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
START, SYSTEM, USER, ASSISTANT = range(4)
# next state by role initial, and the role that may stand there besides (insert, rerole)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
ENDS = (START, ASSISTANT)
# What it costs at most to go on from the first state as the second would: an insertion per turn
# of the roles, and deleting a system row that only the start can keep.
INSTEAD = {(ASSISTANT, START): 2, (USER, START): 7, (START, SYSTEM): 0, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 5,
           (START, USER): 5, (SYSTEM, USER): 5, (ASSISTANT, USER): 5, (USER, ASSISTANT): 5, (START, ASSISTANT): 10, (SYSTEM, ASSISTANT): 10}

_BLANK = r"^[\x20\x09-\x0D]*\z"
_CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audits as persistent linked nodes; node 0 is the empty audit."""

    def __init__(self, base: int = _BASE, mod: int = _MOD):
        self.base, self.mod = base, mod
        self.up: list[list[int]] = [[]]        # ancestors 1, 2, 4, ... steps up
        self.letter = [""]
        self.depth = [0]
        self.hash = [0]
        self.known: dict[tuple[int, str], int] = {}

    def __len__(self) -> int:
        return len(self.letter)

    def add(self, parent: int, letter: str) -> int:
        """The node of the parent's audit and one more letter (the same node if it exists)."""
        node = self.known.get((parent, letter))
        if node is not None:
            return node
        node = len(self.letter)
        ups, k = [parent], 0
        while len(self.up[ups[k]]) > k:
            ups.append(self.up[ups[k]][k])
            k += 1
        self.up.append(ups)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.mod)
        self.known[parent, letter] = node
        return node

    def ancestor(self, node: int, depth: int) -> int:
        step = self.depth[node] - depth
        while step:
            k = step.bit_length() - 1
            node = self.up[node][k]
            step -= 1 << k
        return node

    def _fork(self, a: int, b: int, equal) -> tuple[int, int]:
        """The first nodes, of equal depth, at which two audits part; ``equal`` compares prefixes."""
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not equal(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def fork(self, a: int, b: int) -> tuple[int, int] | None:
        """Where two audits part, or None if one is a prefix of the other.

        Prefixes are compared by their rolling hashes; the prefix found must be one and the same
        node.  If it is not, hashes collided, and the search is done again by identity."""
        d = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, d), self.ancestor(b, d)
        if a == b:
            return None
        x, y = self._fork(a, b, lambda p, q: self.hash[p] == self.hash[q])
        if self.up[x][0] != self.up[y][0]:
            x, y = self._fork(a, b, lambda p, q: p == q)
        return x, y

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` is ASCII-less than audit ``b``."""
        if a == b:
            return False
        parted = self.fork(a, b)
        if parted is None:
            return self.depth[a] < self.depth[b]
        return self.letter[parted[0]] < self.letter[parted[1]]

    def text(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that all the audits pass."""
        top = nodes[0]
        for n in nodes[1:]:
            d = min(self.depth[top], self.depth[n])
            a, b = self.ancestor(top, d), self.ancestor(n, d)
            top = a if a == b else self.up[self._fork(a, b, lambda p, q: p == q)[0]][0]
        return top

    def compacted(self, nodes: list[int]) -> tuple[str, "Audits", list[int]]:
        """The prefix that all audits share, and their remainders as a new set of nodes."""
        top = self.shared(nodes)
        out = Audits(self.base, self.mod)
        moved = []
        for n in nodes:
            here = 0
            for c in self.text(n, top):
                here = out.add(here, c)
            moved.append(here)
        return self.text(top), out, moved


class Repair:
    """The dynamic programme over one conversation, row by row."""

    def __init__(self, compact_at: int = 4096):
        self.nodes, self.prefix = Audits(), []
        self.limit = self.compact_at = compact_at
        # per state: cost, audit, running hash of the repaired rows, whether there is one
        self.best = {START: (0, 0, hashlib.sha256(), False)}

    def _offer(self, found: dict, state: int, cost: int, parent: int, letter: str, source, row: str | None) -> None:
        old = found.get(state)
        if old is not None and old[0] < cost:
            return
        node = self.nodes.add(parent, letter)
        if old is None or cost < old[0] or self.nodes.less(node, old[1]):
            found[state] = (cost, node, source, row)

    def _settle(self, found: dict) -> dict:
        """Hashes are advanced once per state, for the audit that won."""
        out = {}
        for state, (cost, node, (digest, any_row), row) in found.items():
            if row is not None:
                digest = digest.copy()
                digest.update(("\n" + row if any_row else row).encode("utf-8", "surrogatepass"))
                any_row = True
            out[state] = (cost, node, digest, any_row)
        return out

    def _insert(self, best: dict) -> dict:
        """Insertions: from every state to the next, as long as that makes an audit better."""
        changed = True
        while changed:
            changed = False
            for state in sorted(best, key=lambda s: best[s][0]):
                cost, node, digest, any_row = best[state]
                target, role = NEXT[state]
                old = best.get(target)
                total = cost + COST[INSERT]
                if old is not None and old[0] < total:
                    continue
                new = self.nodes.add(node, INSERT)
                if old is None or total < old[0] or self.nodes.less(new, old[1]):
                    best = {**best, **self._settle({target: (total, new, (digest, any_row), f"{role}:")})}
                    changed = True
        return best

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found: dict = {}
        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node, digest, any_row) in self._insert(self.best).items():
            source = (digest, any_row)
            self._offer(found, state, cost + COST[DELETE], node, DELETE, source, None)
            if must_go:
                continue
            kept = FOLLOWS[state].get(role[:1])
            if kept is not None:
                self._offer(found, kept, cost + COST[KEEP] + extra, node, KEEP, source, f"{role}:{text}")
            target, other = NEXT[state]
            self._offer(found, target, cost + COST[REROLE] + extra, node, REROLE, source, f"{other}:{text}")
        self.best = self._settle({s: f for s, f in found.items() if not any(
            found[other][0] + INSTEAD.get((other, s), math.inf) < f[0] for other in found)})
        if len(self.nodes) > self.limit:
            states = list(self.best)
            done, self.nodes, moved = self.nodes.compacted([self.best[s][1] for s in states])
            self.prefix.append(done)
            self.best = {s: (self.best[s][0], n, *self.best[s][2:]) for s, n in zip(states, moved)}
            self.limit = max(self.compact_at, 2 * len(self.nodes))

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best audit that ends in a whole conversation."""
        best, won = self._insert(self.best), None
        for state in ENDS:
            if state in best and (won is None or best[state][0] < won[0]
                                  or (best[state][0] == won[0] and self.nodes.less(best[state][1], won[1]))):
                won = best[state]
        return won[0], "".join(self.prefix) + self.nodes.text(won[1]), won[2].hexdigest()


# ------------------------------------------------------------------------------- the Spark job
_SCHEMA = ("blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string, gaps long")
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is kept of the conversation that a task is reading."""

    def __init__(self, key):
        self.key, self.repair = key, Repair()
        self.faults = [0, 0, 0]
        self.illegal, self.last = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def row(self, turn, role, text, fault) -> None:
        if fault is not None:
            self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:  # ascending: a new value is a new turn
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        self.repair.row(role, text, fault in (0, 1), fault == 2)

    def out(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, *self.faults, self.illegal, *self.repair.result(), gaps)


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows to one row per conversation; a conversation may go on in the next batch."""
    now, names = None, None
    for pdf in batches:
        names = ["conv_id", *(c.split()[0] for c in _SCHEMA.split(", "))]
        done = []
        # a missing id, turn or fault comes as a flag beside a zero: integers stay integers
        for key, no_key, turn, no_turn, role, text, fault, real in zip(
                pdf["conv_id"], pdf["no_conv"], pdf["turn"], pdf["no_turn"], pdf["role"], pdf["text"], pdf["fault"], pdf["real"]):
            key = None if no_key else key
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.out())
                now = _Conversation(key)
            if real:
                now.row(None if no_turn else int(turn), role, text, None if fault < 0 else int(fault))
        if done:
            yield _frame(done, names)
    if now is not None:
        yield _frame([now.out()], names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = list(zip(*rows))
    return pd.DataFrame({n: pd.Series(np.array(c, dtype=object)) for n, c in zip(names, columns)})


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (conv_id, turn, role, text, real; rows that are not
    ``real`` only say that the conversation exists): counts of faults, the cheapest audit, its
    cost, and the digest of the repaired conversation."""
    key = rows.schema["conv_id"].dataType
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "real", "role", "text").orderBy(F.asc_nulls_first("turn"))
    marked = dealt.withColumn("nth", F.row_number().over(same)).withColumn(
        "fault", F.when(F.col("text").rlike(_BLANK), 0).when(F.col("nth") > 1, 1).when(F.col("text").rlike(_CUT), 2).otherwise(-1))
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text", "nth").select(
        F.coalesce("conv_id", F.lit(0).cast(key)).alias("conv_id"), F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "fault", "real")
    return ordered.mapInPandas(_repair_batches, f"conv_id {key.simpleString()}, {_SCHEMA}")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` (NULL: one space) modulo 20: 0 drops the row
    (it stays as not ``real``), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes
    it the user's."""
    def named(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col("conv_id"), F.col("turn"), code.alias("code"), named("role").alias("role"), named("text").alias("text"))
    return rows.select(
        "conv_id", F.when(F.col("code") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("code") == 0, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("real"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def conversation_report(conversations: DataFrame) -> DataFrame:
    """Every conversation damaged, then repaired; see ``damaged`` and ``repair_conversations``."""
    return repair_conversations(damaged(conversations)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
