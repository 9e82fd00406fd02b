"""Benchmark decontamination: windows of benchmark words looked up in every document.

All on the DataFrame API.  The benchmark's windows (ten consecutive words of an item; an
item of fewer words is one window) become a broadcast hash set.  Documents are scanned in
the row, without exploding their words: a window of L words holds a run of g = ceil(L / 2)
words at exactly one position that is a multiple of L - g + 1, so only those positions are
tested, against a Bloom filter of the windows' runs.  The filter is a literal sized by the counted
windows: sixteen bits a run, up to 2^26 bits (8 MB), so about one clean position in seventy passes
for benchmarks of up to four million runs; beyond, more positions pass, and none is lost.  The
windows around a position that passes leave the row with their words, and a join on the words
themselves confirms them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from panelstats.llm.common import broadcast_if_small, let, with_columns_of, written

WINDOW = 10
# Bits of the prefilter per run, and the least and largest filter, as powers of two.
BITS_PER_RUN = 16
MIN_BITS, MAX_BITS = 12, 26

# Fixed values of the contract: words are runs of 0-9, A-Z, a-z and characters from U+0080 on.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 0)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, as an array; NULL has none.

    One ``translate`` turns every separator into a space (NUL, which it takes as an end
    mark, is replaced first); splitting at a single character needs no regular expression.
    """
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit(" "))
    spaced = F.translate(clean, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.filter(F.split(spaced, " "), lambda w: w != F.lit(""))


def _run(length: int) -> tuple[int, int]:
    """Length of the tested run in a window of ``length`` words, and the stride between tests."""
    g = (length + 1) // 2
    return g, length - g + 1


def _fingerprint(ws: Column, start: Column, length: int) -> Column:
    """64-bit fingerprint of the run at ``start``, from its first, middle and last word."""
    g, _ = _run(length)
    return F.xxhash64(F.lit(length), *[F.get(ws, start + F.lit(i)) for i in sorted({0, (g - 1) // 2, g - 1})])


def _places(fp: Column, bits: int) -> list[Column]:
    """The two places of a fingerprint in the Bloom filter."""
    mask = F.lit((1 << bits) - 1)
    return [fp.bitwiseAND(mask), F.shiftright(fp, 32).bitwiseAND(mask)]


def _sequence(first: Column, last: Column, step: int = 1) -> Column:
    """first, first + step, ... up to last; empty when last < first."""
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: win (words joined by a space), ws, len, items."""
    rows = (benchmark.select(F.col("item_id").cast("string").alias("item"),
                             words_of(F.col("text")).alias("ws"))
            .withColumn("n", F.size("ws")).filter(F.col("n") > 0)
            .withColumn("len", F.least(F.col("n"), F.lit(window)))
            .select("item", "ws", "len", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("at"))
            .select("item", "len", F.slice("ws", F.col("at") + 1, F.col("len")).alias("ws")))
    return (rows.groupBy("ws", "len").agg(F.collect_set("item").alias("items"))
            .withColumn("win", F.array_join("ws", " ")))


def filter_bits_for(runs: int) -> int:
    """Size of the filter for so many runs, as a power of two."""
    return min(MAX_BITS, max(MIN_BITS, (max(1, runs) * BITS_PER_RUN - 1).bit_length()))


def _bloom(windows: DataFrame, lengths: list[int], bits: int) -> Column:
    """Bloom filter over the runs of the windows, as a literal of 2^(bits-6) longs."""
    parts = []
    for length in lengths:
        g, _ = _run(length)
        fps = F.transform(F.sequence(F.lit(0), F.lit(length - g)), lambda i: _fingerprint(F.col("ws"), i, length))
        parts.append(windows.filter(F.col("len") == length).select(F.explode(fps).alias("fp")).distinct()
                     .select(F.explode(F.array(*_places(F.col("fp"), bits))).alias("at")))
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    if parts:
        found = (reduce(DataFrame.unionByName, parts).groupBy(F.shiftright("at", 6).alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow())  # at most 2^(bits-6) rows
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return _longs(windows.sparkSession, words)


def _longs(spark: SparkSession, values: np.ndarray) -> Column:
    """One literal array<bigint>, handed to the JVM as bytes (a list of literals would be parsed and
    folded one by one)."""
    jvm, sc = spark._jvm, spark.sparkContext
    longs = sc._gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(values.astype(">i8").tobytes()).asLongBuffer().get(longs)
    return ClassicColumn(jvm.org.apache.spark.sql.functions.lit(longs))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              window: int = WINDOW, filter_bits: int | None = None) -> DataFrame:
    """Contamination of every document.

    Returns one row per input row: ``id_col``, n_words, n_hit (words inside any occurrence
    of a window), n_items, items_sha256 (of the sorted, comma-joined item ids),
    contaminated, digest (SHA-256 of the text, to join verdicts back by).

    NULL and empty texts have no words and no hits; repeated rows and repeated ids each get
    their own row; an empty or all-NULL benchmark finds nothing; items with a NULL id count
    through their windows but carry no id (n_items and the hash leave them out); other
    columns of either table are ignored.  ``filter_bits`` sizes the prefilter (by default by the
    counted windows); it bears on speed alone.
    """
    benchmark = benchmark.select(F.col("item_id"), F.col("text"))
    windows = written(benchmark_windows(benchmark, window), "bench-windows")
    sizes = windows.agg(F.sum(F.octet_length("win") + 40 + 24 * F.size("items")).alias("b"),
                        F.collect_set("len").alias("lens"), F.sum(F.col("len") - F.floor((F.col("len") + 1) / 2) + 1).alias("runs")).first()
    lengths = sorted(sizes["lens"])
    filter_bits = filter_bits or filter_bits_for(sizes["runs"] or 0)
    bloom = _bloom(windows, lengths, filter_bits)
    powers = _longs(docs.sparkSession, np.uint64(1) << np.arange(64, dtype=np.uint64))

    def passes(fp: Column) -> Column:
        """Whether both places of the fingerprint are set."""
        return F.forall(F.array(*_places(fp, filter_bits)), lambda at: F.get(
            bloom, F.shiftright(at, 6).cast("int")).bitwiseAND(F.get(powers, at.bitwiseAND(F.lit(63)).cast("int"))) != F.lit(0))

    def windows_near(ws: Column, length: int) -> Column:
        """(at, len, win) of the windows of ``length`` words around the runs that pass."""
        g, stride = _run(length)
        n = F.size(ws)
        near = F.filter(_sequence(F.lit(0), n - F.lit(g), stride), lambda i: passes(_fingerprint(ws, i, length)))
        starts = F.flatten(F.transform(near, lambda i: _sequence(
            F.greatest(F.lit(0), i - F.lit(stride - 1)), F.least(i, n - F.lit(length)))))
        return F.transform(starts, lambda i: F.struct(
            i.alias("at"), F.lit(length).alias("len"),
            F.array_join(F.slice(ws, i + F.lit(1), F.lit(length)), " ").alias("win")))

    def scan(ws: Column) -> Column:
        empty = F.array().cast("array<struct<at:int,len:int,win:string>>")
        return F.struct(F.size(ws).cast("bigint").alias("n_words"),
                        F.concat(empty, *[windows_near(ws, n) for n in lengths]).alias("found"))

    text = F.col(text_col)
    scanned = docs.select(F.col(id_col).alias("__id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("__digest"),
                          F.monotonically_increasing_id().alias("__row"), let(words_of(text), scan).alias("__s"))
    rows = scanned.select("__id", "__digest", "__row", F.col("__s.n_words").alias("__n"),
                          F.explode_outer("__s.found").alias("__c"))
    known = broadcast_if_small(windows.select("win", "items"), sizes["b"] or 0)
    hits = rows.join(known, F.col("__c.win") == known["win"], "left").groupBy("__row").agg(
        F.first("__id").alias(id_col), F.first("__digest").alias("digest"), F.first("__n").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("__c.at", "__c.len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["len"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(acc["end"], s["at"]))).alias("n")),
        lambda acc: acc["n"])
    return hits.select(id_col, "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.size("spans") > 0).alias("contaminated"), "digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that contain a benchmark window, same columns.

    Equal texts have equal verdicts, so the verdict joins back by the text's digest; rows
    with NULL or repeated ids are judged like any other.
    """
    bad = (find_hits(docs, benchmark, id_col=id_col, text_col=text_col, window=window)
           .filter("contaminated").select(F.col("digest").alias("__digest")).distinct())
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return with_columns_of(keyed.join(bad, "__digest", "left_anti"), docs)
