"""WARC archives: exact round trip, equal bytes, atomic commit."""

import base64
import gzip
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from panelstats.llm import warc
from panelstats.llm.common import filesystem, shared_dir

ROWS = [(i, f"http://h{i % 7}/é{i}\r\nX: y", f"<p>{'x' * (i % 5)}</p>" if i % 3 else f"page {i}\r\n\r\n" * (i + 1)) for i in range(120)]
ROWS += [(500, None, None), (501, "u", ""), (502, "u", "\x00\U0001f600"), (None, "u", "lost"), (None, "v", "<p></p>"), (119, "again", ROWS[119][2]),
         (600, "u", "z" * 3_000_000)]
SCHEMA = "page_id long, url string, html string, payload string, record_type string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "a", "b") for r in ROWS], SCHEMA)


def by_force(rows):
    out, top = [], {}
    for i, _, h in rows:
        h = (h or "").encode()
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    for i, _, h in rows:
        h = (h or "").encode()
        revisit = top[h] not in (-1, i)
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", top[h] if revisit else None))
    return sorted(out, key=str)


def test_records(pages):
    got = [tuple(r) for r in warc.archive_pages(pages).collect()]
    assert sorted(got, key=str) == by_force(ROWS)


def _files(folder):
    store, root = filesystem(folder)
    from pyarrow.fs import FileSelector
    return {x.base_name: store.open_input_stream(x.path, compression=None).read() for x in store.get_file_info(FileSelector(root)) if x.base_name.startswith("part-")}


def test_round_trip_rolls_and_is_deterministic(spark, pages):
    one, two = shared_dir(spark, "t"), shared_dir(spark, "t")
    warc.write_archive(pages, one, roll_bytes=500, shard_bytes=2000)
    warc.write_archive(pages.orderBy(F.desc("url")).repartition(5), two, roll_bytes=500, shard_bytes=2000)
    a, b = _files(one), _files(two)
    assert a == b and len(a) > 5 and all(n.startswith("part-") for n in a)
    assert any("-00001-" in n for n in a)  # rolled
    assert all(hashlib.sha256(d).hexdigest().startswith(n[-24:-8]) for n, d in a.items())
    text = b"".join(gzip.decompress(x) for x in a.values())
    assert text.count(b"WARC/1.1\r\n") == len(ROWS)
    back = {(r.page_id, r.url): r for r in warc.read_archive(spark, one).collect()}
    for i, u, h in ROWS:
        r = back[i, u and u.replace("\r\n", "%0D%0A")]
        assert r.record_type == "revisit" or bytes(r.payload).decode() == (h or "")


def test_damage_is_seen():
    record = warc.encode_record(1, "u", b"abc", warc.base32_sha1(b"abc"), None, False)
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(OSError):
        warc.parse_record(record.replace(b"abc\r\n", b"abd\r\n"))


def test_nothing_is_read_before_the_commit(spark, pages):
    folder = shared_dir(spark, "t")
    with pytest.raises(OSError):
        warc.read_archive(spark, folder)
    assert warc.archive_pages(pages.limit(0), folder).count() == 0


def test_minimum_size_for_revisits(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]
    folder = shared_dir(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, min_revisit_bytes=3)
    assert sorted((r.page_id, r.refers_to) for r in warc.read_archive(spark, folder).collect()) == [(1, None), (2, None), (3, 4), (4, None)]


def _ids(folder, spark):
    """Per shard its least and greatest id and its records."""
    out = {}
    for name, data in _files(folder).items():
        ids = [int(x) for x in re.findall(rb"WARC-Record-ID: <urn:page:(-?\d+)>", gzip.decompress(data))]
        lo, hi, n = out.get(name[5:13], (10**30, -10**30, 0))
        out[name[5:13]] = (min([lo, *ids]), max([hi, *ids]), n + gzip.decompress(data).count(b"WARC-Record-ID: "))
    return [out[k] for k in sorted(out)]


def test_outlier_ids_do_not_crowd_a_shard(spark):
    rows = [(i, "u", f"{i:04d}" * 50) for i in range(400)] + [(2**62, "u", "far"), (-2**62, "u", "near")]
    folder = shared_dir(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder, shard_bytes=4000)
    shards = _ids(folder, spark)
    assert len(shards) > 20 and max(n for _, _, n in shards) <= 20 and sum(n for _, _, n in shards) == 402
    assert all(a[1] < b[0] for a, b in zip(shards, shards[1:]))  # sorted across shards
    assert warc.read_archive(spark, folder).count() == 402


@pytest.mark.parametrize("hot", [None, 7])
def test_a_hot_payload_under_one_id_is_spread(spark, hot):
    rows = [(hot, "u", "same" * 50)] * 300 + [(i, "u", f"{i}") for i in range(20)]
    folder = shared_dir(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder, shard_bytes=10_000)
    shards = _ids(folder, spark)
    assert len(shards) > 8 and max(n for _, _, n in shards) < 100 and sum(n for _, _, n in shards) == 320
    assert warc.read_archive(spark, folder).where("payload_bytes = 200").count() == 300


def test_replacing_an_archive_keeps_the_old_one_until_the_commit(spark, pages, monkeypatch):
    folder = shared_dir(spark, "t")
    warc.write_archive(pages, folder, shard_bytes=2000)
    before, rows = _files(folder), sorted(map(str, warc.read_archive(spark, folder).collect()))
    monkeypatch.setattr(warc, "put_file", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        warc.write_archive(pages.limit(50), folder, shard_bytes=2000)
    assert before.items() <= _files(folder).items()
    assert sorted(map(str, warc.read_archive(spark, folder).collect())) == rows
    monkeypatch.undo()
    warc.write_archive(pages.limit(50), folder, shard_bytes=2000)
    store, root = filesystem(folder)
    manifest = spark.read.parquet(f"{folder}/{json.loads(store.open_input_stream(f'{root}/MANIFEST.json').read())['list']}")
    assert {r["name"] for r in manifest.collect()} == set(_files(folder))
    assert warc.read_archive(spark, folder).count() == 50
