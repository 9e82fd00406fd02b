"""Deterministic sharded WARC writer and reader.

Records are cut into shards by page_id: ids are range-sorted with their bytes, a running sum gives
every id the bytes before it, and a shard holds the ids of one stretch of SHARD_BYTES, so the cuts
depend on the records only and follow their distribution, outliers included.  An id that alone
exceeds a shard (repeated or NULL ids) gets several neighbouring shards, its rows dealt evenly.
A task writes one shard, sorted, a gzip member per record, and rolls to a new file once the
compressed size passes the limit.

Tasks write under temporary names that no other attempt uses and return manifest rows; the
manifest, not the folder, says which attempt counts.  Final names hold a digest of the content, so
a commit never touches a file of the archive it replaces: it renames the listed files, writes the
manifest into the archive, puts MANIFEST.json in place, and only then deletes what is no longer
listed.  A reader sees the old archive or the new one, whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstats.llm.common import broadcast_if_small, filesystem, put_file, shared_dir, written

ROLL_BYTES = 16 << 20      # compressed size from which a shard goes on in a new file
SHARD_BYTES = 32 << 20     # payload bytes aimed at per shard
GZIP_LEVEL = 4
DATE = "2000-01-01T00:00:00Z"  # records carry no clock, so the same input gives the same bytes
MANIFEST_SCHEMA = ("shard bigint, seq int, name string, temp string, records bigint, bytes bigint, "
                   "sha256 string, attempt string")
RECORD_SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                 "refers_to bigint, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _clean(url: str | None) -> str | None:
    """A header value: control characters would end the line, so they are percent-encoded."""
    return url and "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record, headers regenerated from the record itself."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """One gzip member without a time stamp or a file name."""
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        attempt = uuid.uuid4().hex
        made: list[tuple] = []
        out = None

        def close():
            nonlocal out
            if out is not None:
                out["file"].close()
                sha = out["sha"].hexdigest()
                name = f"part-{out['shard']:08d}-{out['seq']:05d}-{sha[:16]}.warc.gz"
                made.append((out["shard"], out["seq"], name, out["temp"], out["records"], out["bytes"], sha, attempt))
                out = None

        def open_file(shard: int, seq: int):
            temp = f".tmp-{attempt}-{shard:08d}-{seq:05d}"
            return {"shard": shard, "seq": seq, "temp": temp, "records": 0, "bytes": 0,
                    "sha": hashlib.sha256(), "file": store.open_output_stream(f"{root}/{temp}", compression=None)}

        for batch in batches:
            for r in batch.to_pylist():
                shard = r["__shard"]
                if out is None or out["shard"] != shard:
                    close()
                    out = open_file(shard, 0)
                elif out["bytes"] >= roll_bytes:
                    seq = out["seq"] + 1
                    close()
                    out = open_file(shard, seq)
                payload = (r["payload"] or "").encode("utf-8", "surrogatepass")
                data = _gzip(encode_record(r["page_id"], r["url"], payload, base32_sha1(payload), r["__refers_to"],
                                           r["__revisit"]))
                out["file"].write(data)
                out["sha"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*made)) or [()] * 8, (
                pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
            names=["shard", "seq", "name", "temp", "records", "bytes", "sha256", "attempt"])

    return run


def _renamer(folder: str):
    """Give each listed file its final name; safe to repeat after a lost task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if store.get_file_info(f"{root}/{r['temp']}").type.name == "File":
                    store.move(f"{root}/{r['temp']}", f"{root}/{r['name']}")
                elif store.get_file_info(f"{root}/{r['name']}").size != r["bytes"]:
                    raise OSError(f"{r['name']} is missing from the archive")
            yield batch

    return run


def shard_bounds(records: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(first, last, shard, parts): the least and greatest id of every stretch of ids, its first
    shard, and how many shards it has.  ``records`` has page_id and __size; NULL ids are a stretch
    at the front."""
    sizes = records.groupBy("page_id").agg(F.sum(F.col("__size") + F.lit(256)).alias("b"))  # with headers
    ranged = written(sizes.repartitionByRange(F.col("page_id").asc_nulls_first()).sortWithinPartitions(F.col("page_id").asc_nulls_first())
                     .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "warc-ids")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = ranged.groupBy("part").agg(F.sum("b").alias("pb")).select("part", F.coalesce(F.sum("pb").over(upto), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("b").over(inner), F.lit(0))).join(parts, "part")
    own = F.col("b") > shard_bytes  # an id of several shards is a stretch of its own
    placed = placed.select("page_id", "b", own.alias("own"), F.expr(f"(offset + inside) div {int(shard_bytes)}").alias("bucket"))
    stretch = placed.groupBy("bucket", F.when(F.col("own"), F.col("page_id")).alias("single"), "own", F.col("page_id").isNull().alias("none")).agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.sum("b").alias("b"))
    stretch = stretch.withColumn("parts", F.when(F.col("own"), F.ceil(F.col("b") / F.lit(shard_bytes))).otherwise(F.lit(1)).cast("long"))
    order = Window.orderBy(F.desc("none"), "first", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return written(stretch.select("first", "last", "none", "parts", F.coalesce(F.sum("parts").over(order), F.lit(0)).alias("shard")), "warc-bounds")


_BOUNDS: dict[str, tuple] = {}  # bounds that a Python worker has read


def _shard_finder(files: list[str]):
    """A column function: the shard of an id, and the number of shards of its stretch."""
    key = files[0] if files else ""

    def bounds():
        if key not in _BOUNDS:
            tables = []
            for uri in files:
                store, path = filesystem(uri)
                with store.open_input_file(path) as f:
                    tables.append(pq.read_table(f))
            t = pa.concat_tables(tables)
            none, last, shard, parts = (t.column(c).to_numpy(zero_copy_only=False) for c in ("none", "last", "shard", "parts"))
            none = none.astype(bool)
            given = np.flatnonzero(~none)
            given = given[np.argsort(last[given].astype(np.int64), kind="stable")]
            _BOUNDS.clear()
            _BOUNDS[key] = (last[given].astype(np.int64), shard[given], parts[given],
                            (int(shard[none][0]), int(parts[none][0])) if none.any() else (0, 1))
        return _BOUNDS[key]

    @F.pandas_udf("shard long, parts long")
    def find(ids: pd.Series) -> pd.DataFrame:
        last, shard, parts, nowhere = bounds()
        missing = ids.isna().to_numpy()
        at = np.minimum(np.searchsorted(last, ids.fillna(0).astype("int64").to_numpy(), side="left"), max(0, len(last) - 1))
        return pd.DataFrame({"shard": np.where(missing, nowhere[0], shard[at] if len(last) else 0),
                             "parts": np.where(missing, nowhere[1], parts[at] if len(last) else 1)})

    return find


def write_archive(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``folder``; returns the manifest.

    Of records with equal payloads of at least ``min_revisit_bytes``, the one with the
    largest page_id is the response and the others revisit it.  NULL html is the empty
    payload; a NULL url leaves the target out; NULL page_ids come first and revisit like any
    other; rows that repeat the largest page_id are responses alike; an empty table gives an
    archive of no files; other columns are ignored.  An existing archive is replaced.
    """
    spark = pages.sparkSession
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    records = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                           F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    records = records.withColumn("__sha", F.sha1("payload")).withColumn("__size", F.octet_length("payload").cast("bigint"))
    copies = (records.filter(F.col("__size") >= min_revisit_bytes).groupBy("__sha", "__size")
              .agg(F.max("page_id").alias("__top"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
              .select(F.col("__sha").alias("__csha"), F.col("__size").alias("__csize"), "__top"))
    copies = written(copies, "warc-copies")  # one row per payload that occurs twice or more
    bounds = shard_bounds(records, shard_bytes)
    shards = bounds.agg(F.sum("parts").alias("n")).first()["n"] or 1
    revisit = F.col("__top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__top"))
    copies = broadcast_if_small(copies, 64 * copies.count())
    place = _shard_finder(sorted(bounds.inputFiles()))(F.col("page_id"))
    placed = (records.withColumn("__place", place)
              .join(copies, (F.col("__sha") == F.col("__csha")) & (F.col("__size") == F.col("__csize")), "left")
              .select("page_id", "url", "payload", "__sha", F.coalesce(revisit, F.lit(False)).alias("__revisit"),
                      F.when(revisit, F.col("__top")).alias("__refers_to"),
                      # rows of an id of several shards are dealt by their place in the input: they may be equal
                      (F.col("__place.shard") + F.when(F.col("__place.parts") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__place.parts")))
                       .otherwise(0)).alias("__shard")))
    dealt = (placed.repartitionById(shards, F.col("__shard").cast("int"))
             .sortWithinPartitions("__shard", F.col("page_id").asc_nulls_first(), "__sha", "url").drop("__sha"))
    listed = shared_dir(spark, "warc-manifest")
    dealt.mapInArrow(_writer(folder, roll_bytes), MANIFEST_SCHEMA).write.parquet(listed)
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(listed)
    moved = manifest.repartition(max(1, min(shards, 200))).mapInArrow(_renamer(folder), MANIFEST_SCHEMA)
    total = moved.agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    own = f"manifest-{uuid.uuid4().hex}"  # the list lies in the archive, so nothing else has to stay
    manifest.drop("temp", "attempt").coalesce(1).write.parquet(f"{folder}/{own}")
    put_file(f"{folder}/MANIFEST.json", json.dumps(
        {"files": total["files"], "records": total["records"] or 0, "bytes": total["bytes"] or 0, "list": own}).encode())
    _clear(spark, folder, own)
    return spark.read.parquet(f"{folder}/{own}")


def _clear(spark: SparkSession, folder: str, own: str) -> None:
    """Delete what the manifest does not list: files of the archive before, and of broken attempts.
    The files of the folder are compared by a join; the driver deletes names, batch by batch."""
    store, root = filesystem(folder)
    there = []
    for info in store.get_file_info(_all_in(root)):
        if info.type.name == "Directory":
            if info.base_name.startswith("manifest-") and info.base_name != own:
                store.delete_dir(info.path)
        elif info.base_name.startswith((".tmp-", "part-")):
            there.append((info.base_name,))
    if there:
        names = spark.createDataFrame(there, "name string")
        for r in names.join(spark.read.parquet(f"{folder}/{own}").select("name"), "name", "left_anti").toLocalIterator():
            store.delete_file(f"{root}/{r['name']}")


def _all_in(root: str):
    from pyarrow.fs import FileSelector
    return FileSelector(root)


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(z.decompress(chunk))
            chunk = b""
            if z.eof:
                yield b"".join(parts)
                chunk, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise OSError("the archive ends within a record")


def parse_record(data: bytes) -> dict:
    """The fields of one record; its block digest is checked, a response's payload too."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    if "sha1:" + base32_sha1(block) != field["WARC-Block-Digest"] or rest[len(block):] != b"\r\n\r\n":
        raise OSError(f"record {field['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda urn: None if urn is None or urn[10:-1] == "none" else int(urn[10:-1])
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base32_sha1(payload) != digest):
        raise OSError(f"the payload of {field['WARC-Record-ID']} is damaged")
    return {"page_id": number(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "payload_bytes": length,
            "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": number(field.get("WARC-Refers-To")),
            "payload": None if revisit else payload}


def _reader(folder: str, with_payload: bool):
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        row = parse_record(data)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += 200 + len(row["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Read back the records of a committed archive, file by file, checking every digest."""
    store, root = filesystem(folder)
    with store.open_input_stream(f"{root}/MANIFEST.json") as f:
        done = json.loads(f.read())
    files = spark.read.parquet(f"{folder}/{done['list']}").select("name")
    spread = files.repartition(max(1, min(done["files"], 10_000)), "name")
    return spread.mapInArrow(_reader(folder, with_payload), RECORD_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages, read the archive back, and list its records."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    write_archive(pages, folder)
    back = read_archive(pages.sparkSession, folder, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
