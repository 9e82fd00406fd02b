"""Line dedup across the corpus by a deletion-neighbourhood join.

A line is its words, lower-cased.  Lines of equal words are copies, however short they are;
only lines without a word never go.  Lines of eight words or
more are also duplicates when one word inserted, deleted or replaced turns one into the
other.  The earliest line (least document id, then line number) is kept: a line goes if an
equal or a near line comes before it.

Near lines are found by their deletion neighbourhoods: a line emits a hash of itself and of
every variant with one word left out.  Two lines of equal length are near if they agree on a
variant with the same place left out; a line is near a longer one if it equals one of its
variants.  Equal hashes only name the earliest line of their group (a minimum, no pairs
within a group), and the words of the two lines then confirm the edit distance.

Emitting all variants of all lines would multiply the corpus by the length of its lines, so
lines without a possible neighbour are set aside first, exactly: an edit leaves the first or
the second half of a line as it was, so a near line shares one of its half keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import let, with_columns_of, written
from panelstats.llm.minhash import mix64

MIN_WORDS = 1        # lines without a word are never duplicates
EDIT_MIN_WORDS = 8   # from this length (of the shorter line) one word may differ
OTHER_SPACE = "\t\r\x0b\x0c"
HAS_WORD = r"[^ \t\r\x0B\x0C]"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SUB, _DEL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def line_words(line: Column) -> Column:
    text = F.lower(line)
    for c in OTHER_SPACE:  # rare characters: a search each is far cheaper than one translate
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != F.lit(""))


def _half_keys(ws: Column) -> Column:
    """(key, side) of the halves that a near line of the same length, one word more or one
    word less would share; side 0 is a beginning, 1 an end.  A line has three: an even number of
    words has two beginnings and one end, an odd number one beginning and two ends."""
    n = F.size(ws)
    half = F.floor(n / 2).cast("int")

    def head(length: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(0), F.slice(ws, F.lit(1), length)).alias("h"), F.lit(0).alias("side"))

    def tail(length: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(1), F.slice(ws, n - length + F.lit(1), length)).alias("h"), F.lit(1).alias("side"))
    other = F.when(n % 2 == 0, head(half - F.lit(1))).otherwise(tail(half))
    return F.when(n >= EDIT_MIN_WORDS, F.array(head(half), tail(n - half), other))


def _text_keys(text: Column) -> list[Column]:
    """128 bits that name a text; with the id they address a row."""
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled).alias("t1"), F.xxhash64(F.lit(1), filled).alias("t2")]


def corpus_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: id, t1, t2, no, k1, k2, n, halves (NULL below EDIT_MIN_WORDS words)."""
    text = F.col(text_col).cast("string")
    lines = docs.select(F.col(id_col).alias("id"), *_text_keys(text), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    seen = let(line_words(F.col("line")), lambda ws: F.struct(
        F.xxhash64(ws).alias("k1"), F.xxhash64(F.lit(1), ws).alias("k2"), F.size(ws).alias("n"), _half_keys(ws).alias("halves")))
    return lines.select("id", "t1", "t2", "no", seen.alias("s")).select("id", "t1", "t2", "no", "s.*")


def _address() -> Column:
    """Orders lines from the earliest on; NULL ids come last."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "no")


def _pick_lines(id_kind: pa.DataType):
    """Candidate lines of the texts: columns of the batch are id, text, wanted (list of
    no, k1, k2, sides); the lines' words come out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = text.split("\n")
                out += [(doc, w["no"], w["k1"], w["k2"], w["sides"], lines[w["no"]]) for w in wanted]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (id_kind, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                names=["id", "no", "k1", "k2", "sides", "line"])

    return run


def words_in(line: str) -> list[str]:
    """The words as :func:`line_words` gives them."""
    return [w for w in line.lower().translate({ord(c): " " for c in OTHER_SPACE}).split(" ") if w]


def neighbourhood(words: list[str], sides: int = 3) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Hashes of the variants with one word left out: keyed by place (replacement), plain
    (deletion), and that of the whole line in the key space of the plain ones.

    ``sides`` says where an edit may lie: 1 the end, 2 the beginning, 3 anywhere.
    """
    n = len(words)
    a = mix64(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]).astype(np.uint64))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * power[:n], dtype=np.uint64)])
    without = upto[:n] + (upto[n] - upto[1:]) * _INVERSE
    lo = 0 if sides & 2 else (n - 1) // 2
    hi = n if sides & 1 else n - n // 2
    places = np.arange(lo, hi, dtype=np.uint64)
    without = without[lo:hi]
    by_place = mix64(without + (places + np.uint64(1)) * _SUB)
    plain = np.unique(mix64(without ^ _DEL)) if n > EDIT_MIN_WORDS else np.zeros(0, np.uint64)
    return by_place, plain, mix64(upto[n:] ^ _DEL)[0]


def _variants(id_kind: pa.DataType):
    """Rows (v, role, id, no, k1, k2); role 0 replacement, 1 deletion, 2 the line itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, roles, owner = [], [], []
            rows = range(batch.num_rows)
            for i, sides, line in zip(rows, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                by_place, plain, whole = neighbourhood(words_in(line), sides)
                hashes += [by_place, plain, np.array([whole], np.uint64)]
                roles += [np.zeros(len(by_place), np.int8), np.ones(len(plain), np.int8), np.full(1, 2, np.int8)]
                owner.append(np.full(len(by_place) + len(plain) + 1, i))
            if not owner:
                continue
            hashes, roles, owner = np.concatenate(hashes).view(np.int64), np.concatenate(roles), pa.array(np.concatenate(owner))
            for at in range(0, len(hashes), 1 << 17):
                part = slice(at, at + (1 << 17))
                take = owner[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[part]), pa.array(roles[part]), *[batch.column(c).take(take) for c in range(4)]],
                    names=["v", "role", "id", "no", "k1", "k2"])

    return run


def within_one_word(a: list[str], b: list[str]) -> bool:
    """Whether at most one word inserted, deleted or replaced turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i:] == long[i + 1:] or (len(a) == len(b) and short[i + 1:] == long[i + 1:])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one_word(words_in(x), words_in(y))
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select(["k1", "k2"]).filter(pa.array(good, pa.bool_()))


def near_lines(docs: DataFrame, lines: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2) of the lines that have a near line before them.

    ``lines`` is :func:`corpus_lines`, ``keys`` has every distinct line's first address.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = lines.schema["id"].dataType
    id_kind, id_sql = to_arrow_type(id_type), id_type.simpleString()
    halves = lines.filter("halves IS NOT NULL").select("k1", "k2", F.explode("halves").alias("h")).select("k1", "k2", "h.*")
    shared = written(halves.groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"))
                     .filter("lo <> hi").select("h"), "shared-halves")
    sides = F.when(F.col("side") == 0, 1).otherwise(2)
    wanted = written(halves.join(shared, "h", "left_semi").groupBy("k1", "k2").agg(F.bit_or(sides).alias("sides"))
                     .join(keys, ["k1", "k2"]).select("k1", "k2", "sides", "first.id", "first.no", "t1", "t2"), "wanted-lines")
    per_text = (wanted.groupBy("id", "t1", "t2").agg(F.collect_list(F.struct("no", "k1", "k2", "sides")).alias("wanted"))
                .select(F.col("id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "wanted"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_text_keys(text))
    at = F.col("id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))
    chosen = (texts.join(written(per_text, "wanted-texts"), at).select("id", "text", "wanted")
              .mapInArrow(_pick_lines(id_kind), f"id {id_sql}, no int, k1 bigint, k2 bigint, sides int, line string"))
    chosen = written(chosen, "candidate-lines")
    variants = written(chosen.select("id", "no", "k1", "k2", "sides", "line").mapInArrow(
        _variants(id_kind), f"v bigint, role tinyint, id {id_sql}, no int, k1 bigint, k2 bigint"), "variants")
    line = F.struct(_address().alias("at"), "k1", "k2")
    least = [F.min(F.when(F.col("role") == r, line)).alias(f"m{r}") for r in (0, 1, 2)]
    counts = [F.count_if(F.col("role") == r).alias(f"c{r}") for r in (0, 1, 2)]
    groups = written(variants.groupBy("v").agg(*least, *counts).filter("c0 > 1 OR (c1 > 0 AND c2 > 0)")
                     .select("v", "m0", "m1", "m2"), "variant-groups")
    other = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = (variants.join(groups, "v").select("k1", "k2", _address().alias("at"), other.alias("o"))
             .filter("o.at < at").select("k1", "k2", F.col("o.k1").alias("o1"), F.col("o.k2").alias("o2")).distinct())
    words = chosen.groupBy("k1", "k2").agg(F.first("line").alias("line"))
    words = written(words, "line-words")
    theirs = words.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("line").alias("other"))
    both = written(pairs, "line-pairs").join(words, ["k1", "k2"]).join(theirs, ["o1", "o2"])
    return both.select("k1", "k2", "line", "other").mapInArrow(_confirm, "k1 bigint, k2 bigint").distinct()


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to remove: id, t1, t2 (the row's text), no, near (False for copies)."""
    # lines without words go by a filter on the written table: before it, the filter would be pushed
    # below the projection and compute every line's words twice
    lines = written(corpus_lines(docs, id_col, text_col), "lines").filter(F.col("n") >= MIN_WORDS)
    keys = written(lines.groupBy("k1", "k2").agg(F.min(F.struct(_address().alias("a"), "t1", "t2")).alias("f"), F.count(F.lit(1)).alias("n"))
                   .select("k1", "k2", F.col("f.a").alias("first"), "f.t1", "f.t2", "n"), "line-keys")
    near = written(near_lines(docs, lines, keys, id_col, text_col), "near-lines")
    verdict = written(keys.select("k1", "k2", "first", "n").join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "left")
                      .filter("n > 1 OR near").select("k1", "k2", F.col("first").alias("__first"), F.coalesce("near", F.lit(False)).alias("near")),
                      "line-verdicts")
    return (lines.select("id", "t1", "t2", "no", "k1", "k2").join(verdict, ["k1", "k2"])
            .filter(F.col("near") | (F.col("__first") != _address())).select("id", "t1", "t2", "no", "near"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with duplicate lines taken out of the texts, plus __lines, __copies, __near
    (numbers of lines, removed copies, removed near lines) and __left (whether a line with a
    word is left: False once all of them have gone).

    NULL and empty texts stay as they are; an empty table gives no rows.  Rows of one id share
    line numbers: a line is not a duplicate of itself, so repeated rows come out alike.  NULL ids
    count as the latest.  Texts are rebuilt by column functions: rows stay in the JVM.
    """
    lists = duplicate_lines(docs, id_col=id_col, text_col=text_col).groupBy("id", "t1", "t2").agg(
        F.collect_set(F.when(~F.col("near"), F.col("no"))).alias("__c"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("__n"))
    lists = written(lists.select(F.col("id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "__c", "__n"), "removed")
    t1, t2 = _text_keys(F.col(text_col).cast("string"))
    at = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__t1")) & (F.col("__k2") == F.col("__t2"))
    wide = docs.withColumns({"__k1": t1, "__k2": t2}).join(lists, at, "left")
    text, none = F.col(f"`{text_col}`").cast("string"), F.array().cast("array<int>")
    copies, near = F.coalesce("__c", none), F.coalesce("__n", none)

    def rebuilt(lines: Column) -> Column:
        # array_except and array_union look numbers up in hash sets, so long texts stay linear
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.array_union(copies, near))
        kept = F.transform(rest, lambda i: F.get(lines, i))
        return F.struct(F.size(lines).cast("long").alias("lines"), F.array_join(kept, "\n").alias("text"),
                        F.exists(kept, lambda line: line.rlike(HAS_WORD)).alias("left"))

    parts = wide.withColumn("__s", F.when(text.isNotNull() & F.col("__c").isNotNull(), let(F.split(text, "\n"), rebuilt)))
    return parts.select(
        *[F.coalesce("__s.text", text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("__s.lines", F.when(text.isNotNull(), F.size(F.split(text, "\n"))).cast("long"), F.lit(0)).alias("__lines"),
        F.size(copies).cast("long").alias("__copies"), F.size(near).cast("long").alias("__near"),
        F.coalesce("__s.left", F.lit(True)).alias("__left"))


def drop_duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with cleaned texts, same columns, without the rows that nothing is left of."""
    return with_columns_of(dedup_lines(docs, id_col=id_col, text_col=text_col).filter("__left"), docs)


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_lines, n_copies, n_near (removed lines), left, text_sha256 of the cleaned text."""
    out = dedup_lines(docs.select(id_col, text_col), id_col=id_col, text_col=text_col)
    return out.select(id_col, F.col("__lines").alias("n_lines"), F.col("__copies").alias("n_copies"), F.col("__near").alias("n_near"),
                      F.col("__left").alias("left"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_sha256"))
