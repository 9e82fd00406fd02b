"""Same results for 1 and 64 shuffle partitions."""

import pytest

import __spark_entry__ as E
from conftest import SMALL

KEYS = ["stratified_split", "stratified_folds", "mode_first_seen", "first_row_per_key", "mode_fill",
        "classification_report", "attribution_path", "disagreement_over_time", "box_outliers"]


@pytest.mark.parametrize("key", KEYS)
def test_partition_count_does_not_change_results(spark, key):
    results = []
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, E.queries()[key](spark, SMALL).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
