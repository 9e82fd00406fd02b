"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is a weighted set: its five-word shingles, each with weight 1 + ln(occurrences).  The
similarity of two documents is their probability Jaccard, sum over shared shingles i of
``1 / sum_j max(x_j / x_i, y_j / y_i)``; without repeated shingles it is the Jaccard similarity.
Every shingle starts a Poisson process with its weight as the rate; each arrival falls into one
of 64 registers, and a register keeps the shingle that arrives first.  Two documents agree on a
register with the probability of their similarity.  A document stops drawing arrivals once none
can come before the latest register (early termination).

Registers are banded four by four.  In every bucket all members are first compared with one
leader.  Buckets whose members are then still in several classes are split by every other band
they could agree on, and each part gets a leader of its own.  These two rounds join most of
what belongs together with pairs that grow with the documents.  In the last round the members of
a bucket that are still in different classes are compared: those outside its largest class with
each other and with that class, in blocks of bounded size, each pair in the first bucket it
shares.  Pairs whose 64 registers, and then the 512 registers of a finer signature (of the
texts of this round), allow the threshold are verified within the block from all shingles of the
texts; a link joins two classes, whose other pairs need no test any more.  So a block gives fewer
links than it has classes, and no other pair is written.  A pair is a link if its similarity,
computed from the whole texts, is 0.8 or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import broadcast_if_small, with_columns_of, written
from panelstats.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4      # at similarity 0.8 a pair shares a bucket with probability 0.9998
REGISTERS = BANDS * ROWS
MIN_AGREE = 36           # registers; 51 +- 3 of 64 agree at similarity 0.8, fewer than 36 four times in a million
FINE = 512               # registers of the finer signature, four bits each
FINE_AGREE = 374         # 416 +- 9 of 512 agree at similarity 0.8 (chance agreements of four bits included)
WORD = re.compile(r"\w+")
CACHE_WORDS = 200_000
BLOCK = 512              # members of a bucket that a task compares with as many others at once

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([3, 0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Distinct shingles of texts, with a bounded memory of words' hashes."""

    def __init__(self):
        self.known = _WordHashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(sorted 64-bit shingles, occurrences); a text of fewer words is one shingle, a text
        without words has none."""
        words = WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        h = np.array([known[w] for w in words], dtype=np.uint64)
        if len(h) < SHINGLE:
            h = np.concatenate([h, np.full(SHINGLE - len(h), len(h), np.uint64)])
        n = len(h) - SHINGLE + 1
        s = h[:n] * _ODD[0]
        for k in range(1, SHINGLE):
            s = s + h[k:k + n] * _ODD[k]
        return np.unique(mix64(s), return_counts=True)


def signature(shingles: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in every register.

    Arrivals are drawn in blocks for all shingles at once; a shingle leaves when its next
    arrival lies beyond the latest register.  Its draws depend on the shingle and the number
    of the arrival only, so they are the same in every document.
    """
    rate = 1.0 + np.log(counts)
    best = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    active, time, drawn = shingles, np.zeros(len(shingles)), 0
    need = 6 * registers
    while len(active):
        width = max(1, -(-need // len(active)))
        number = (np.arange(drawn, drawn + width, dtype=np.uint64) + np.uint64(1)) * _C1
        draw = mix64(active[:, None] + number)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        times = np.empty((len(active), width + 1))
        times[:, 0] = time
        np.divide(-np.log(uniform), rate[:, None], out=times[:, 1:])
        np.cumsum(times, axis=1, out=times)
        slot = (mix64(draw ^ _C3) % np.uint64(registers)).astype(np.int64).ravel()
        flat = times[:, 1:].ravel()
        early = np.flatnonzero(flat < best.max())
        np.minimum.at(best, slot[early], flat[early])
        first = early[flat[early] == best[slot[early]]]
        owner[slot[first]] = active[first // width]
        time, drawn = times[:, -1], drawn + width
        on = time < best.max()
        active, time, rate = active[on], time[on], rate[on]
    return owner


def band_keys(owner: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different in every band."""
    rows = owner.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _C1
    for r in range(ROWS):
        key = mix64(key + rows[:, r] * _ODD[r])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles_of = Shingler()
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            shingles, counts = shingles_of(text)
            sizes.append(len(shingles))
            owner = signature(shingles, counts) if len(shingles) else None
            keys.append(np.zeros(0, np.int64) if owner is None else band_keys(owner).view(np.int64))
            sketches.append(b"" if owner is None else (owner >> np.uint64(56)).astype(np.uint8).tobytes())
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat),
             pa.array(sketches, pa.binary())], names=["id", "key", "n", "bands", "sketch"])


def probability_jaccard(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> float:
    """Similarity of two documents from their sorted shingles and occurrences.

    For a shared shingle i, the shingles j with y_j / x_j <= y_i / x_i add x_j / x_i to its sum and
    the others y_j / y_i: sums over the shingles sorted by that ratio."""
    if a_counts.max(initial=1) == 1 and b_counts.max(initial=1) == 1:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(1, len(a) + len(b) - both)
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = 1.0 + np.log(a_counts)
    y[np.searchsorted(every, b)] = 1.0 + np.log(b_counts)
    ratio = np.divide(y, x, out=np.full(len(every), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    both = (x > 0) & (y > 0)
    last = np.searchsorted(ratio, ratio[both], side="right") - 1
    below, above = np.cumsum(x)[last], y.sum() - np.cumsum(y)[last]
    return float((1.0 / (below / x[both] + above / y[both])).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts reach the threshold."""
    shingles_of = Shingler()
    last, there = None, None
    for batch in batches:
        keep = []
        a_text, b_text, b_key = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist()
        for x, y, key in zip(a_text, b_text, b_key):
            if key != last:
                last, there = key, shingles_of(y)
            keep.append(probability_jaccard(*shingles_of(x), *there) >= THRESHOLD - 1e-12)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def text_key(text: Column) -> Column:
    """128 bits that name a text; equal texts are one node of the graph."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of whose registers (a byte each) at least MIN_AGREE are equal."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
        enough = (x == y).sum(axis=1) >= MIN_AGREE
        yield batch.select(["a", "b"]).filter(pa.array(enough, pa.bool_()))


def _compared(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of every bucket with its leader, where their registers allow
    a similarity of the threshold and they are not of one class yet.

    ``buckets`` has part, key, root, score and sketch.  The leader is the member with the
    highest score, which shares most with the others.
    """
    lead = (buckets.groupBy("part").agg(F.max(F.struct("score", "key", "root", "sketch")).alias("l"),
                                        F.count(F.lit(1)).alias("size")).filter("size > 1")
            .select("part", F.col("l.key").alias("b"), F.col("l.root").alias("broot"),
                    F.col("l.sketch").alias("bs")))
    pairs = (buckets.join(written(lead, "leaders"), "part")
             .filter(F.col("root") != F.col("broot"))
             .select(F.col("key").alias("a"), "b", "sketch", "bs"))
    return written(pairs.mapInArrow(_agree, "a binary, b binary").distinct(), "pairs")


def _texts_of(keys: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(__key, __text) of the texts that ``keys`` (__key) names, each once."""
    known = broadcast_if_small(keys, 40 * keys.count())
    texts = (docs.select(text_key(F.col(text_col)).alias("__key"), F.col(text_col).cast("string").alias("__text"))
             .join(known, "__key", "left_semi").groupBy("__key").agg(F.first("__text").alias("__text")))
    return written(texts, "texts")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Links among ``pairs`` (a, b); only texts that occur in a pair are kept."""
    texts = _texts_of(written(pairs.select(F.explode(F.array("a", "b")).alias("__key")).distinct(), "wanted"), docs, text_col)
    with_a = pairs.join(texts, F.col("a") == F.col("__key")).select("a", "b", F.col("__text").alias("ta"))
    both = with_a.join(texts, F.col("b") == F.col("__key")).select("a", "b", "ta", F.col("__text").alias("tb"))
    return written(both.mapInArrow(_verify, "a binary, b binary"), "links")


def fine_sketch(shingles: np.ndarray, counts: np.ndarray) -> bytes:
    """Four bits of each of the 512 registers of a finer signature."""
    bits = (signature(shingles, counts, FINE) >> np.uint64(60)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).tobytes()


def _sketch_finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles_of = Shingler()
    for batch in batches:
        found = [shingles_of(t) for t in batch.column(1).to_pylist()]
        fine = [fine_sketch(*f) for f in found]
        grams = [shingles.tobytes() for shingles, _ in found]
        times = [counts.astype(np.int32).tobytes() if counts.max(initial=1) > 1 else b"" for _, counts in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (fine, grams, times))],
                                         ["key", "fine", "grams", "times"])


def _cross(table: pa.Table) -> pa.Table:
    """Links (a, b) between the two sides of a block, or within its only side: pairs of different
    classes that share no earlier bucket, whose signatures allow a similarity of the threshold and whose
    shingles reach it.  The classes of a link are one from then on."""
    side, band = table.column("side").to_numpy(), table.column("band")[0].as_py()
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = table.column("i")[0].as_py() == table.column("j")[0].as_py() and not table.column("heavy")[0].as_py()
    keys = table.column("key").to_pylist()
    _, root = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)
    sketch, fine = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(len(keys), -1) for c in ("sketch", "fine"))
    bands = np.asarray(table.column("bands").combine_chunks().values).reshape(len(keys), BANDS)[:, :band]
    grams, times = table.column("grams"), table.column("times")
    a, b = [], []

    def shingles_of(i):
        shingles, counts = np.frombuffer(grams[i].as_py(), np.uint64), np.frombuffer(times[i].as_py(), np.int32)
        return shingles, counts if len(counts) else np.ones(len(shingles), np.int32)

    for k, u in enumerate(x):
        v = x[k + 1:] if within else y
        v = v[(root[v] != root[u]) & ~(bands[v] == bands[u]).any(axis=1)]
        v = v[(sketch[v] == sketch[u]).sum(axis=1) >= MIN_AGREE]
        differ = fine[v] ^ fine[u]
        v = v[((differ & 0x0F) == 0).sum(axis=1) + ((differ & 0xF0) == 0).sum(axis=1) >= FINE_AGREE]
        own = shingles_of(u) if len(v) else None
        for w in v:
            if root[w] != root[u] and probability_jaccard(*own, *shingles_of(w)) >= THRESHOLD - 1e-12:
                root[root == root[w]] = root[u]
                a.append(max(keys[u], keys[w]))
                b.append(min(keys[u], keys[w]))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _remaining(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Links (a, b) that join the classes of texts that share a bucket and are still in different
    classes.

    The members of a bucket outside its largest class (the rest) and those of that class are cut
    into blocks by the hash of the key; a task compares a block of the rest with a block of either.
    """
    rows = nodes.select(F.posexplode("bands").alias("band", "bucket"), "key", "root")
    parts = written(rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size")), "bucket-classes")
    top = F.max(F.struct("size", "root")).alias("top")
    mixed = written(parts.groupBy("bucket").agg(top, F.sum("size").alias("all"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
                    .select("bucket", F.col("top.root").alias("largest"), F.ceil(F.col("top.size") / BLOCK).cast("int").alias("heavy_blocks"),
                            F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("rest_blocks")), "mixed-buckets")
    members = written(rows.join(mixed, "bucket").select("bucket", "band", "key", F.col("root") == F.col("largest"), "heavy_blocks", "rest_blocks")
                      .toDF("bucket", "band", "key", "is_heavy", "heavy_blocks", "rest_blocks"), "mixed-members")
    wanted = written(members.select(F.col("key").alias("__key")).distinct(), "wanted")
    fine = written(_texts_of(wanted, docs, text_col).mapInArrow(_sketch_finely, "key binary, fine binary, grams binary, times binary"), "fine-sketches")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("is_heavy"), F.col("heavy_blocks")).otherwise(F.col("rest_blocks"))).cast("int")

    def place(heavy, i, j, side):
        return F.struct(F.lit(heavy).alias("heavy"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    each_rest, each_heavy = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("rest_blocks", "heavy_blocks"))
    places = F.when(F.col("is_heavy"), F.transform(each_rest, lambda r: place(True, F.col("own"), r, F.lit(0)))).otherwise(F.concat(
        F.transform(each_heavy, lambda h: place(True, h, F.col("own"), F.lit(1))),
        F.transform(each_rest, lambda r: place(False, F.least(F.col("own"), r), F.greatest(F.col("own"), r), F.col("own") > r))))
    dealt = (members.withColumn("own", own).select("bucket", "band", "key", F.explode(places).alias("p")).select("bucket", "band", "key", "p.*")
             .join(nodes.select("key", "root", "sketch", "bands").join(fine, "key"), "key"))
    return written(dealt.groupBy("bucket", "heavy", "i", "j").applyInArrow(_cross, "a binary, b binary"), "links")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (a, b) that are not in ``tested``, either way round."""
    return written(pairs.join(tested, ["a", "b"], "left_anti").join(
        tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "pairs")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key (of its text), root (of its text's class), n.

    Texts without words (also NULL) are in no class: root is NULL.  Repeated rows and ids
    share the class of their text; other columns are ignored; an empty table has no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    signed = written(slim.mapInArrow(_sign, f"id {kind}, key binary, n bigint, bands array<bigint>, sketch binary"), "signatures")
    nodes = written(signed.filter("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    rows = nodes.select("key", F.explode("bands").alias("bucket"))
    full = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    score = written(rows.join(full, "bucket").groupBy("key").agg(F.sum("size").alias("score")), "scores")
    # texts that share a bucket with another
    nodes = written(nodes.join(score, "key").withColumn("root", F.col("key")), "candidates")
    members = nodes.select(F.explode("bands").alias("part"), "key", "n", "root", "score", "sketch")
    first = _compared(members)
    links = _verified(first, docs, text_col)
    taken = written(links.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("taken")), "taken")
    nodes = written(nodes.join(taken, "key", "left").withColumn("root", F.least("root", "taken")).drop("taken"), "candidates")
    second = _compared(_split(nodes))
    second = _untested(second, first)
    links = written(links.unionByName(_verified(second, docs, text_col)), "links")
    roots = written(connected_components(links), "roots")
    nodes = written(nodes.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "candidates")
    found = _remaining(nodes, docs, text_col)
    if not found.isEmpty():
        links = written(links.unionByName(found), "links")
        roots = written(connected_components(links), "roots")
    return (signed.select("id", "key", "n").join(roots, "key", "left")
            .select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root")))


def _split(nodes: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes, in a part for every other band."""
    rows = nodes.select(F.posexplode("bands").alias("i", "bucket"), "key", "root")
    mixed = written(rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
                    .select("bucket"), "mixed-buckets")
    here = written(rows.join(mixed, "bucket", "left_semi").groupBy("key").agg(F.collect_list("i").alias("own")), "mixed-members")
    # a band's number is at most BANDS, so a text is in fewer than BANDS ** 2 / 2 parts
    both = F.flatten(F.transform("own", lambda i: F.transform(
        F.filter("own", lambda j: j > i), lambda j: F.xxhash64(F.get("bands", i), F.get("bands", j)))))
    return nodes.join(here, "key").select(F.explode(both).alias("part"), "key", "n", "root", "score", "sketch")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id (least id of its class), class_size
    (rows in it) and kept (whether it is the one that stays).

    Rows without words are classes of their own and stay.  Ids that are NULL come last.  An
    empty table gives no rows.
    """
    classes = written(near_duplicate_classes(docs, id_col=id_col, text_col=text_col), "classes")
    heads = written(classes.filter("root IS NOT NULL").groupBy("root")
                    .agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "heads")
    out = classes.join(heads, "root", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
                      F.when(F.col("root").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class, that of the least (id, text key); same columns.

    Rows that repeat an id with its text count as one, the one whose other columns come first
    as JSON.  Rows without words stay.  An empty table gives no rows.
    """
    classes = written(near_duplicate_classes(docs, id_col=id_col, text_col=text_col), "classes")
    heads = (classes.filter("root IS NOT NULL").groupBy("root")
             .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("h")).select("h.id", "h.key"))
    stay = written(heads.unionByName(classes.filter("root IS NULL").select("id", "key").distinct())
                   .select(F.col("id").alias("__id"), F.col("key").alias("__skey")), "stay")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(row, F.to_json(F.struct(*others))) if others else F.first(row)
    keyed = docs.groupBy(F.col(f"`{id_col}`").alias("__own"), text_key(F.col(f"`{text_col}`")).alias("__key")).agg(first.alias("__row"))
    kept = keyed.join(stay, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__skey")), "left_semi")
    return with_columns_of(kept.select("__row.*"), docs)
