"""Sorted digest array and URL verdicts."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from panelstats.llm import url_filter as uf


def by_force(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, rule in uf.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


URLS = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://b.www.example.com/en/a", "http://example.com",
        "http://example.com?x/en/", "http://x.net/es/1", "http://x.net/es", "ftp://y.net/fr/", "no scheme", "", None,
        "http://", "http://com/", "http://notexample.com/en/", "x://y://com/a", "http://example.com/EN/", "http://e.com#/en/",
        "http://example.com/en/" + "a" * 100_000, "http://ÀB.net/fr/é"]


def test_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages).collect()}
    assert got == {i: by_force(u) for i, u in enumerate(URLS + URLS)}


def test_empty_table_and_several_indexes(spark):
    assert uf.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert len(uf.ship_index(spark, uf.RULES, max_bytes=80)) > 1


@pytest.mark.parametrize("hash_fn", [uf.digest, lambda key: len(key) % 2])
def test_probe_confirms_strings_under_collisions(tmp_path, hash_fn):
    rules = [("block", f"h{i}.org/") for i in range(50)] + [("allow", "h7.org/")]
    for suffix, data in uf.build_index(rules, hash_fn).items():
        (tmp_path / f"i.{suffix}").write_bytes(data)
    index = uf.DigestArray(str(tmp_path / "i"), hash_fn)
    assert isinstance(index.keys, np.memmap) and (np.diff(index.keys.astype(float)) >= 0).all()
    assert index.probe(["h3.org/", "h7.org/", "h99.org/", ""]) == ["b", "a", None, None]


def test_no_rules():
    files = uf.build_index([])
    assert files["keys"] == b"" and files["text"] == b""


def test_a_table_of_a_million_rules(spark):
    """Index parts are sorted ranges written by tasks; verdicts follow the longest listed rule."""
    n = 1_000_000
    rules = spark.range(n).select(F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("verdict"),
                                  F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".org/"), F.when(F.col("id") % 2 == 0, "en/").otherwise("")).alias("rule"))
    rules = rules.unionByName(spark.createDataFrame([("allow", "org/"), ("allow", "h9.org/"), ("block", "h9.org/"), (None, "x.com/"), ("maybe", "y.com/"), ("block", None)],
                                                    "verdict string, rule string"))
    stems, shapes = uf.ship_index_table(rules, max_bytes=8 << 20)
    assert len(stems) > 2 and shapes == ((1, 2), (1, 4))
    last = -1
    ranges = sorted((int(k[0]), int(k[-1])) for k in (uf.DigestArray(SparkFiles.get(s)).keys for s in stems))
    for lo, hi in ranges:
        assert last < lo <= hi
        last = hi
    urls = [f"http://a.h{i}.org/{'en/' if i % 4 == 0 else ''}x" for i in range(0, n, 9973)] + ["http://h9.org/", "http://x.com/", "http://y.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge_urls(pages, rules).collect()}
    for k, i in enumerate(range(0, n, 9973)):
        listed = f"h{i}.org/" + ("en/" if i % 2 == 0 else "")
        fits = i % 2 == 1 or i % 4 == 0
        assert got[k] == ((listed, "block" if i % 3 == 0 else "allow") if fits else ("org/", "allow"))
    assert [got[k] for k in range(len(urls) - 3, len(urls))] == [("h9.org/", "block"), (None, "allow"), (None, "allow")]


def test_an_empty_rule_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in uf.judge_urls(pages, spark.createDataFrame([], "verdict string, rule string")).collect()] == ["allow"]
