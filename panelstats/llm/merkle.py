"""Merkle manifest of a table: a tree of digests per source, and a tree over the sources.

Every level is one table of nodes.  A level equijoins its nodes with the indices of their
siblings (``idx XOR 1`` for a binary tree, slot offsets within the run otherwise); the rows of
slot zero then emit the digests of the parents.  The siblings found on the way up are the
proofs: going down, a node's path is its own siblings followed by its parent's path, so a
record is checked with its path alone.

Indices come from one range sort by (source, id, digest): rows are numbered within their
partition and the counts of (partition, source) give every partition its offset, so a source
that holds most of the rows is spread like any other.  Texts are read once and never shuffled;
only digests travel.  The driver sees the number of levels and the root.

Defined cases: NULL fields count as ``-``; a NULL source is a source of its own, ordered first;
NULL ids come first within their source; rows with equal ids are ordered by their digests, and
wholly equal rows are leaves of their own (which of two equal rows has which place does not
matter).  An empty table has no root and gives no rows.  Columns that are not named are ignored,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
_PATH = "array<struct<before:string,after:string>>"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def encoded(value: Column) -> Column:
    """A field as hashed: ``-`` for NULL, else the byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the encoded fields, one after another."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256)


def group_key(source: Column) -> Column:
    """The source as a key without NULLs that sorts NULL first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, the place of a row within its ``tree`` by ``order``, and ``n``, the
    tree's number of rows.  Equal rows are told apart by their place in the input only to spread
    them over partitions."""
    spread = rows.withColumn("place", F.monotonically_increasing_id())
    keys = ["tree", *order, "place"]
    ranged = written(spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn("at", F.monotonically_increasing_id()).drop("place"), "merkle-sorted")
    part = F.shiftright("at", 33)
    cells = (ranged.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("first")))
    own = Window.partitionBy("tree")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("tree", "part", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("k").over(own).alias("n"))
    return (ranged.withColumn("part", part).join(cells, ["tree", "part"])
            .withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` (tree, idx, n, hash, ...) with the digests of their siblings: ``before`` those
    of lower slots, ``after`` those of higher ones, each concatenated from left to right."""
    slot, run = F.pmod("idx", F.lit(arity)), F.floor(F.col("idx") / F.lit(arity))
    out, before, after = nodes, [], []
    for d in range(1, arity):
        target = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else (
            F.col("idx") - slot + F.pmod(slot + F.lit(d), F.lit(arity)))
        shifted = nodes.select("tree", F.col("idx").alias(f"target{d}"), F.col("hash").alias(f"sibling{d}"))
        out = out.withColumn(f"target{d}", target).join(shifted, ["tree", f"target{d}"], "left")
        before.append(F.when(slot + F.lit(d) >= arity, F.col(f"sibling{d}")))
        after.append(F.when(slot + F.lit(d) < arity, F.col(f"sibling{d}")))
    return (out.withColumns({"before": F.concat_ws("", *before), "after": F.concat_ws("", *after), "run": run.cast("long"),
                             "slot": slot}).drop(*[f"{p}{d}" for d in range(1, arity) for p in ("target", "sibling")]))


def parents(level: DataFrame, arity: int = ARITY) -> DataFrame:
    """The next level: the rows of slot zero hash themselves and their siblings."""
    return level.where(F.col("slot") == 0).select(
        "tree", F.col("run").alias("idx"), F.ceil(F.col("n") / F.lit(arity)).cast("long").alias("n"),
        F.sha2(F.concat("hash", "after").cast("binary"), 256).alias("hash"))


def levels(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees at once, from the leaves up, and one root row per tree.

    A tree leaves when one node remains; the loop is as long as the largest tree is high.
    """
    width = leaves.agg(F.max("n")).first()[0] or 0
    found, nodes, roots = [], leaves, []
    while True:
        roots.append(nodes.where(F.col("n") == 1).select("tree", "hash", F.lit(len(found)).alias("height")))
        if width <= 1:
            return found, reduce(DataFrame.unionByName, roots)
        found.append(written(with_siblings(nodes.where(F.col("n") > 1), arity), f"merkle-level{len(found)}"))
        nodes, width = parents(found[-1], arity), -(-width // arity)


def paths(found: list[DataFrame], tops: DataFrame, keep: Sequence[str], leaves: DataFrame) -> DataFrame:
    """The leaves (columns ``keep``) with ``path``: their siblings level by level up to the tree's
    root, then the path that ``tops`` (tree, height, path, ...) gives beyond it.

    A node's path is its siblings and its parent's path; the parent is a node of the next level,
    or the root where the tree ends.
    """
    extra = [c for c in tops.columns if c not in ("tree", "height", "path")]
    tops = tops.withColumn("idx", F.lit(0).cast("long"))
    lone = leaves.where(F.col("n") == 1).join(tops.drop("idx").where(F.col("height") == 0), "tree").select("tree", "path", *extra, *keep)
    below = None
    for k, level in reversed(list(enumerate(found))):
        above = tops.where(F.col("height") == k + 1).select("tree", "idx", "path", *extra)
        above = above if below is None else above.unionByName(below)
        own = list(keep) if k == 0 else []
        below = (level.select("tree", "idx", "run", "before", "after", *own)
                 .join(above.withColumnsRenamed({"idx": "run", "path": "above"}), ["tree", "run"])
                 .select("tree", "idx", F.concat(F.array(F.struct("before", "after")), "above").alias("path"), *extra, *own))
    return lone if below is None else below.drop("idx").unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


@dataclass
class Manifest:
    """A built manifest: the leaves, the levels of the source trees, the subroots (tree, hash,
    path to the root) and the root (None for an empty table)."""

    leaves: DataFrame
    found: list[DataFrame]
    subroots: DataFrame
    root: str | None
    keep: list[str]

    def proofs(self) -> DataFrame:
        """Every leaf with its digest, subroot and path to the root."""
        return paths(self.found, self.subroots.withColumnRenamed("hash", "subroot"), self.keep, self.leaves)


def build_manifest(rows: DataFrame, keep: Sequence[str], order: Sequence[str], arity: int = ARITY) -> Manifest:
    """Manifest of ``rows`` (tree, hash, and what ``keep`` and ``order`` name)."""
    keep = list(dict.fromkeys([*keep, "hash"]))
    leaves = written(numbered(rows, order), "merkle-leaves")
    found, roots = levels(leaves, arity)
    roots = written(roots, "merkle-subroots")
    top_leaves = written(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "hash"), ["member"]),
                         "merkle-sources")
    top_found, top = levels(top_leaves, arity)
    first = top.first()
    tops = top.select("tree", "height", F.array().cast(_PATH).alias("path"))
    heights = roots.select(F.col("tree").alias("member"), "height")
    subroots = paths(top_found, tops, ["member", "hash"], top_leaves).drop("tree").join(heights, "member").withColumnRenamed("member", "tree")
    return Manifest(leaves, found, written(subroots, "merkle-paths"), first["hash"] if first else None, keep)


def manifest_report(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered copy of it still
    leads to the root.  Documents whose id has an even CRC-32 are tampered with: their text loses
    its line feeds (a NULL id or text stays)."""
    fields = [_q(f) for f in FIELDS]
    cut = F.when(F.pmod(F.crc32(_q("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.translate(_q("text"), "\n", ""))
    changed = F.when(cut != _q("text"), digest([cut if f == "text" else _q(f) for f in FIELDS]))
    rows = docs.select(group_key(_q("source")).alias("tree"), _q("doc_id").alias("doc_id"), digest(fields).alias("hash"),
                       changed.alias("tampered"))
    m = build_manifest(written(rows, "merkle-digests"), ["doc_id", "tampered"], ["doc_id", "hash"], arity)
    root = F.lit(m.root).cast("string")
    return m.proofs().select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))

