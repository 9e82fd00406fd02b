"""URL filter over a sorted digest array.

The rules' keys (host + path prefix) are hashed to 64 bits, sorted and saved as one array
file next to their strings.  Spark ships the files to every executor (``addFile``); tasks
memory-map them, so all workers of a machine share one copy.  For a batch of URLs every key
that could fit (host suffix x path prefix) is hashed, probed by a vectorised binary search,
and a hit counts only after its stored string is compared in full.

A rule list may be a table: its keys are then digested, range-sorted by digest and written as
index parts by Spark tasks, each part one range of digests; the driver sees the parts' names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from panelstats.llm.common import put_file, shared_dir, written

# Fixed values of the contract: (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT_VERDICT = "allow"  # what the lookup says of a URL that no listed key fits
# Size up to which an index is shipped; a longer list is cut into several indexes.
INDEX_BYTES = 256 << 20


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def build_index(rules: Iterable[tuple[str, str]], hash_fn=digest) -> dict[str, bytes]:
    """The files of the index of (verdict, rule) pairs, by suffix.

    ``keys`` holds the sorted digests, ``offs`` the strings' offsets and ``text`` the
    strings, each the verdict's initial + the rule.  Of equal rules the last one holds.
    """
    last = {rule: verdict for verdict, rule in rules}
    items = sorted((hash_fn(rule), rule, verdict) for rule, verdict in last.items())
    texts = [(verdict[0] + rule).encode("utf-8", "surrogatepass") for _, rule, verdict in items]
    return {"keys": np.array([h for h, _, _ in items], dtype=np.uint64).tobytes(),
            "offs": np.cumsum([0, *map(len, texts)], dtype=np.uint64).tobytes(), "text": b"".join(texts)}


class DigestArray:
    """A memory-mapped index: sorted 64-bit keys, probed in bulk, confirmed by string."""

    def __init__(self, stem: str, hash_fn=digest):
        self.hash_fn = hash_fn
        self.keys = self._map(f"{stem}.keys", np.uint64)
        self.offs = self._map(f"{stem}.offs", np.uint64)
        self.text = self._map(f"{stem}.text", np.uint8)

    @staticmethod
    def _map(path: str, kind):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)

    def _confirm(self, at: int, h: int, key: str) -> str | None:
        """Verdict initial of ``key`` among the entries with digest ``h`` from ``at`` on."""
        want = key.encode("utf-8", "surrogatepass")
        while at < len(self.keys) and int(self.keys[at]) == h:
            entry = self.text[int(self.offs[at]):int(self.offs[at + 1])].tobytes()
            if entry[1:] == want:
                return entry[:1].decode()
            at += 1
        return None

    def probe(self, keys: list[str]) -> list[str | None]:
        """Verdict initial (a or b) of every key, None where it is not listed."""
        out: list[str | None] = [None] * len(keys)
        if not len(self.keys) or not keys:
            return out
        h = np.fromiter(map(self.hash_fn, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.keys, h)
        found = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h)
        for i in found.tolist():
            out[i] = self._confirm(int(at[i]), int(h[i]), keys[i])
        return out


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; the
    path up to ``? #``.  Both empty without ``://`` and for NULL."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def candidates(host: str, path: str, labels: tuple[int, ...], lengths: tuple[int, ...]) -> list[str]:
    """Keys that could fit, longest first: host suffixes of the listed numbers of labels with
    path prefixes of the listed lengths."""
    parts = host.split(".")
    hosts = [".".join(parts[-n:]) for n in labels if n <= len(parts)]
    out = [h + path[:n] for h in hosts for n in lengths if n <= len(path)]
    return sorted(set(out), key=lambda k: (-len(k), k))


def _shapes(rules: Iterable[tuple[str, str]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Numbers of host labels and lengths of paths that occur in the rules."""
    labels, lengths = set(), set()
    for _, rule in rules:
        host, slash, path = rule.partition("/")
        labels.add(host.count(".") + 1)
        lengths.add(len(slash + path))
    return tuple(sorted(labels)), tuple(sorted(lengths))


def _judge(stems: list[str], shapes: tuple, default: str):
    names = {"a": "allow", "b": "block"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [DigestArray(SparkFiles.get(s)) for s in stems]
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            flat, owner = [], []
            for i, (host, path) in enumerate(urls):
                keys = candidates(host, path, *shapes)
                flat += keys
                owner += [i] * len(keys)
            rule: list = [None] * len(urls)
            verdict = [default] * len(urls)
            found = [index.probe(flat) for index in indexes]
            for i, key, *hits in zip(owner, flat, *found):
                hit = next((x for x in hits if x), None)
                if hit and rule[i] is None:  # longest first
                    rule[i], verdict[i] = key, names[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()),
                 pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])

    return run


def ship_index(spark: SparkSession, rules: Iterable[tuple[str, str]], max_bytes: int = INDEX_BYTES) -> list[str]:
    """Build the indexes of a rule list on the driver, where the list was read, and hand their
    files to the executors; a list beyond ``max_bytes`` becomes several indexes."""
    chunks, size = [[]], 0
    for rule, verdict in {r: v for v, r in rules}.items():
        size += len(rule) * 4 + 17
        if size > max_bytes:
            chunks.append([])
            size = len(rule) * 4 + 17
        chunks[-1].append((verdict, rule))
    folder, stems = shared_dir(spark, "url-index"), []
    for chunk in chunks:
        stems.append(f"urls-{uuid.uuid4().hex}")
        for suffix, data in build_index(chunk).items():
            put_file(f"{folder}/{stems[-1]}.{suffix}", data)
            spark.sparkContext.addFile(f"{folder}/{stems[-1]}.{suffix}")
    return stems


def _index_parts(folder: str):
    """Sorted (verdict, rule) rows of one range of digests to the files of an index part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(v, r) for batch in batches for v, r in zip(batch.column("verdict").to_pylist(), batch.column("rule").to_pylist())]
        stems = [f"urls-{uuid.uuid4().hex}"] if rules else []
        for stem in stems:  # a part is bounded by the range's bytes; a lost attempt leaves files that nobody names
            for suffix, data in build_index(rules).items():
                put_file(f"{folder}/{stem}.{suffix}", data)
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string())], ["stem"])

    return run


@F.pandas_udf(LongType())
def _ordered_digest(rule: pd.Series) -> pd.Series:
    """The digest as a signed number of the same order."""
    return rule.map(lambda r: digest(r) - (1 << 63)).astype("int64")


def ship_index_table(rules: DataFrame, max_bytes: int = INDEX_BYTES) -> tuple[list[str], tuple]:
    """Index parts of a table (verdict, rule), built by tasks; and the rules' shapes.  Of equal
    rules block holds; rows with NULLs or other verdicts are left out."""
    spark = rules.sparkSession
    rules = (rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict"))
             .where(F.col("verdict").isin("allow", "block") & F.col("rule").isNotNull())
             .groupBy("rule").agg(F.max("verdict").alias("verdict")))
    rules = written(rules.withColumn("digest", _ordered_digest("rule")), "url-rules")
    host, path = F.substring_index("rule", "/", 1), F.length("rule") - F.length(F.substring_index("rule", "/", 1))
    about = rules.agg(F.sum(F.octet_length("rule") + 17).alias("bytes"), F.collect_set(F.size(F.split(host, "\\."))).alias("labels"),
                      F.collect_set(path).alias("lengths")).first()
    parts = max(1, -(-(about["bytes"] or 0) // max_bytes))
    folder = shared_dir(spark, "url-index")
    made = rules.repartitionByRange(parts, "digest").mapInArrow(_index_parts(folder), "stem string")
    stems = [r["stem"] for r in written(made, "url-index-parts").collect()]  # one per part
    for stem in stems:
        for suffix in ("keys", "offs", "text"):
            spark.sparkContext.addFile(f"{folder}/{stem}.{suffix}")
    return stems, (tuple(sorted(about["labels"])), tuple(sorted(about["lengths"])))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame = RULES, *, id_col: str = "page_id",
               url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """host, path, rule and verdict of every row's URL, with ``id_col``.

    A rule ``host/path`` fits its host and all subdomains if the URL's path starts with the
    rule's; the longest wins.  Without one, rule is NULL and the verdict is ``default``.
    NULL urls and urls without ``://`` have an empty host and path, which no rule fits;
    repeated rows are judged one by one; other columns are ignored; an empty table gives no rows.
    ``rules`` are (verdict, rule) pairs, or a table with these columns for lists of any length.
    """
    if isinstance(rules, DataFrame):
        stems, shapes = ship_index_table(rules)
    else:
        rules = [(v, r) for v, r in rules]
        stems, shapes = ship_index(pages.sparkSession, rules), _shapes(rules)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = slim.schema["id"].dataType.simpleString()
    return (slim.mapInArrow(_judge(stems, shapes, default),
                            f"id {kind}, host string, path string, rule string, verdict string")
            .withColumnRenamed("id", id_col))
