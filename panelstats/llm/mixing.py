"""Mixing sources to target weights by a Pfair schedule.

Every source is cut into blocks of documents.  A source with weight w gives its k-th block
(from 0) the release time floor(k / w) and the deadline ceil((k + 1) / w), in slots of one
block; in every slot the released block with the earliest deadline goes next.  Such a
schedule leaves every source less than one block away from weight x slots at every slot.

With integer shares q (weight q / Q, Q their sum) all windows repeat every Q slots, so one period
is scheduled and a document finds its slot from its rank within its source by arithmetic.

The period is not simulated slot by slot.  A block goes in the first slot from its release on in
which no block of an earlier deadline goes; so the slots that the blocks up to a deadline take do
not depend on later deadlines, and are those in which a queue of these blocks is busy: a running
sum and a running minimum over the slots.  Every round cuts the blocks by deadline into eight
parts, finds the slots of each by such windows, and goes on with each part and its slots as a
problem of its own; the rounds are the logarithm of the period, for any number of sources.

Positions in the mix are prefix sums over the blocks (a row per block of documents, not per
document), handed back to the documents by the (source, hash cell) that they are ranked in.

A source that has used up its blocks leaves its later slots empty; the other sources go on
by their own windows, and ``mix_position`` counts the documents that are really there.
Nothing is dropped or repeated.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.llm.common import broadcast_if_small, written
from panelstats.llm.merkle import numbered

BLOCK_DOCS = 16
# A source's share is RESOLUTION times the square root of its part of the corpus, rounded
# up: large sources are damped, small ones raised, and none gets a zero weight.
RESOLUTION = 100
# Ranks are counted per (source, leading hexadecimal digits of the id's hash): enough digits for
# cells of about so many rows.
CELL_ROWS = 16_384
PARTS = 8            # parts that a round of the schedule cuts a problem into
SLOT_CELL = 65_536   # slots whose blocks are summed up in one window


def source_shares(docs: DataFrame, *, source_col: str = "source", weights: Mapping[str, int] | None = None,
                  resolution: int = RESOLUTION) -> DataFrame:
    """source, n, q: rows and integer share of every source in the table (NULL is a source).

    ``weights`` gives integer shares by name; a source that it leaves out gets share 1.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        every = counts.agg(F.collect_list(F.struct("source", "n")).alias("s"), F.sum("n").alias("total"))
        q = F.ceil(F.lit(float(resolution)) * F.sqrt(F.col("n").cast("double") / F.col("total").cast("double")))
        return every.select(F.inline("s"), "total").select("source", "n", q.cast("int").alias("q"))
    given = F.lit(1)
    for name, share in weights.items():
        if int(share) < 1:
            raise ValueError("shares are positive integers")
        given = F.when(F.col("source") == F.lit(name), F.lit(int(share))).otherwise(given)
    return counts.select("source", "n", given.cast("int").alias("q"))


def pfair_period(shares: DataFrame) -> DataFrame:
    """One period of the schedule: slot, j, k, period (Q), source, q and n, a row per slot.

    ``shares`` is the output of :func:`source_shares`.  j numbers the sources by name (NULL
    first); the block k of source j goes in ``slot``.  Ties of deadlines go to the lower j.
    """
    named = shares.select(F.lit("").alias("tree"), "source", F.col("n").alias("n_docs"), "q")
    sources = written(numbered(named, ["source"]).select(F.col("idx").alias("j"), "source", "n_docs", "q"), "mix-sources")
    period = sources.agg(F.sum("q").alias("p")).first()["p"] or 0
    total, k = F.lit(period).cast("long"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("k")
    blocks = sources.select("j", "q", k).select(
        F.lit("").alias("tree"), "j", "k", F.expr(f"k * {period}L div q").alias("r"), F.expr(f"((k + 1) * {period}L + q - 1) div q").alias("deadline"))
    jobs = written(numbered(blocks, ["deadline", "j"]).select("j", "k", "r", F.col("idx").alias("p"), F.lit(0).cast("long").alias("g"), F.col("n")),
                   "mix-blocks")
    slots = sources.sparkSession.range(period).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("t"), F.col("id").alias("slot"), total.alias("n"))
    size = period
    while size > 1:
        jobs, slots = _cut(jobs, slots)
        size = -(-size // PARTS)
    return jobs.select("j", "k", "g").join(slots.select("g", "slot"), "g").join(sources, "j").select(
        "slot", "j", "k", total.alias("period"), "source", "q", F.col("n_docs").alias("n"))


def _bound(i: Column) -> Column:
    """Blocks in the first ``i`` parts of a problem of ``n``."""
    return F.floor((i * F.col("n") + F.lit(PARTS - 1)) / F.lit(PARTS)).cast("long")


def _cut(jobs: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems g (jobs by priority p and release r, slots t, n of each) cut into parts.

    The first i parts are served in the slots in which their queue is busy: with C(t) blocks
    released up to slot t, min(C(t), min over s <= t of C(s - 1) - s + t + 1) are served up to t.
    """
    part = F.lit(PARTS) - sum((F.col("p") < _bound(F.lit(i))).cast("int") for i in range(1, PARTS))
    jobs = jobs.withColumn("part", part)
    came = jobs.groupBy("g", F.col("r").alias("t")).agg(*[F.count_if(F.col("part") <= i).alias(f"a{i}") for i in range(1, PARTS)])
    run = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    here = slots.join(came, ["g", "t"], "left").na.fill(0, [f"a{i}" for i in range(1, PARTS)])
    here = here.select("g", "t", "slot", "n", *[F.col(f"a{i}") for i in range(1, PARTS)], *[F.sum(f"a{i}").over(run).alias(f"c{i}") for i in range(1, PARTS)])
    here = here.select("g", "t", "slot", "n", *[F.least(F.col(f"c{i}"), F.min(F.col(f"c{i}") - F.col(f"a{i}") - F.col("t")).over(run) + F.col("t") + 1)
                                                .alias(f"d{i}") for i in range(1, PARTS)])
    served = [F.lit(0).cast("long"), *[F.col(f"d{i}") for i in range(1, PARTS)], F.col("t") + 1]
    before = F.lag("now", 1).over(Window.partitionBy("g").orderBy("t"))
    here = here.select("g", "t", "slot", "n", F.array(*served).alias("now")).withColumn(
        "before", F.coalesce(before, F.array(*[F.lit(0).cast("long")] * (PARTS + 1))))
    # the slot's part is the first whose blocks it serves
    first = F.lit(PARTS + 1) - sum((F.get("now", F.lit(i)) > F.get("before", F.lit(i))).cast("int") for i in range(1, PARTS + 1))
    here = written(here.withColumn("part", first), "mix-slots")

    part = F.col("part")
    sized = (_bound(part) - _bound(part - F.lit(1))).alias("n")
    new_slots = here.select((F.col("g") * PARTS + F.col("part") - 1).alias("g"),
                            (F.get("now", F.col("part")) - F.get("now", F.col("part") - 1) - 1).alias("t"), "slot", sized)
    new_jobs = jobs.join(here.select("g", F.col("t").alias("r"), "before"), ["g", "r"]).select(
        "j", "k", (F.get("before", F.col("part")) - F.get("before", F.col("part") - 1)).alias("r"),
        (F.col("p") - _bound(part - F.lit(1))).alias("p"), (F.col("g") * PARTS + F.col("part") - 1).alias("g"), sized)
    return written(new_jobs, "mix-blocks"), new_slots


def mix(docs: DataFrame, *, weights: Mapping[str, int] | None = None, block_docs: int = BLOCK_DOCS,
        id_col: str = "doc_id", source_col: str = "source", resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` with mix_block (block number within its source), mix_slot and mix_position.

    Reading the rows by mix_position gives the mix.  Within a source, documents go by the
    MD5 of their id (a fixed shuffle), then by id.  NULL ids come first, rows with equal ids
    in an order fixed by a hash of their whole row; NULL is a source of its own; an empty
    table gives an empty result; columns of ``docs`` called mix_* are replaced.

    A hot source is no hot key: ranks are counted per (source, hash cell), offsets come from
    a prefix sum over the cells, and only cells are sorted.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    period = written(pfair_period(source_shares(docs, source_col=source_col, weights=weights, resolution=resolution)),
                     "mix-period")
    about = period.agg(F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + 64).alias("bytes"), F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("rows"),
                       F.max("period").alias("period")).first()
    size, block, total = about["bytes"] or 0, int(block_docs), about["period"] or 0
    digits = max(1, math.ceil(math.log(max(2, (about["rows"] or 0) / CELL_ROWS), 16)))
    numbers = period.filter("k = 0").select(F.col("source").alias("__source"), F.col("j").alias("__j"),
                                            F.col("q").alias("__q"), F.col("n").alias("__all"))
    keyed = docs.withColumns({"__md5": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))})
    keyed = keyed.withColumn("__cell", F.substring("__md5", 1, digits))
    keyed = keyed.join(broadcast_if_small(numbers, size), F.col(source_col).eqNullSafe(F.col("__source")))
    cells = keyed.groupBy("__j", "__cell").agg(F.count(F.lit(1)).alias("__n"), F.first("__q").alias("__q"), F.first("__all").alias("__all"))
    upto = Window.partitionBy("__j").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.withColumn("__offset", F.coalesce(F.sum("__n").over(upto), F.lit(0))), "mix-cells")
    placed = _block_places(cells, period.select(F.col("j").alias("__pj"), F.col("k").alias("__pk"), "slot"), size, block, total)
    rest = [F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])]
    within = Window.partitionBy("__j", "__cell").orderBy("__md5", F.col(id_col), *rest)
    ranked = (keyed.withColumn("__in", F.row_number().over(within) - 1)
              .join(placed, (F.col("__j") == F.col("__cj")) & (F.col("__cell") == F.col("__cc")))
              .withColumn("__rank", F.col("__offset") + F.col("__in"))
              .withColumn("__block", F.expr(f"__rank div {block}")))
    mine = F.get("__blocks", (F.col("__block") - F.expr(f"__offset div {block}")).cast("int"))
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__block").alias("mix_block"), mine["slot"].alias("mix_slot"),
                         (mine["at"] + F.expr(f"__rank % {block}")).alias("mix_position"))


def _block_places(cells: DataFrame, slots: DataFrame, slots_bytes: int, block: int, period: int) -> DataFrame:
    """Per cell (__cj, __cc, __offset) the blocks its rows are in, as an array of (block, slot,
    at): ``at`` is the number of documents in earlier slots."""
    touched = F.sequence(F.expr(f"__offset div {block}"), F.expr(f"(__offset + __n - 1) div {block}"))
    rows = cells.select("__j", "__cell", "__offset", "__q", "__all", F.explode(touched).alias("block"))
    rows = rows.join(broadcast_if_small(slots, slots_bytes), (F.col("__j") == F.col("__pj")) & (F.expr("block % __q") == F.col("__pk"))).select(
        "__j", "__cell", "__offset", "block", F.expr(f"block div __q * {period}L + slot").alias("slot"),
        F.least(F.lit(block).cast("long"), F.col("__all") - F.col("block") * block).alias("size"),
        (F.col("block") * block >= F.col("__offset")).alias("begins"))
    rows = written(rows, "mix-cell-blocks")
    # a block counts once, in the cell that it begins in
    own = rows.where("begins").select("slot", "size", F.expr(f"slot div {SLOT_CELL}").alias("sc"))
    upto = Window.orderBy("sc").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("sc").agg(F.sum("size").alias("n")).select("sc", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("sc").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    at = own.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, "sc").select(
        "slot", (F.col("before") + F.col("inside")).alias("at"))
    return rows.select("__j", "__cell", "__offset", "block", "slot").join(at, "slot").groupBy(
        F.col("__j").alias("__cj"), F.col("__cell").alias("__cc"), "__offset").agg(
        F.sort_array(F.collect_list(F.struct("block", "slot", "at"))).alias("__blocks"))
