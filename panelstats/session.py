"""Session defaults and the few cluster-facing helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

# Bytes above which a derived table is never broadcast.  Session conf
# ``panelstats.broadcast.maxBytes`` overrides it.
BROADCAST_BYTE_LIMIT = 64 << 20


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    """An integer setting from the session conf (``spark.conf.set(key, n)``), else default."""
    value = spark.conf.get(key, None)
    return int(value) if value not in (None, "") else int(default)


def get_session(app: str = "panelstats", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume: UTC, ANSI, AQE, no UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    # Partition sizing: scans split at 128 MB; AQE coalesces shuffle output towards
    # 128 MB partitions and splits skewed join partitions.  On a cluster it sizes by bytes
    # rather than by core count (fewer, fuller tasks on a busy cluster).
    on_cluster = not (master or "").startswith("local")
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.files.maxPartitionBytes", "128m")
          .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
          .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", str(not on_cluster).lower())
          .config("spark.sql.ansi.enabled", "true")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where nothing is configured, a local session (unit tests, a laptop) gets a private folder
    that goes with the process; a cluster session gets an error, because a folder of the
    driver's machine would not reach its executors.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="panelstats-shared-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def checkpoint_root(spark: SparkSession) -> str:
    return _checkpoint_root(spark)


_OPEN: list[list[str]] = []  # paths handed out within the open scratch blocks


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables, models)."""
    root = _checkpoint_root(spark).rstrip("/")
    path = "/".join([root, "panelstats", *parts, uuid.uuid4().hex])
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables and models that are written within the block go when it ends: for a caller that
    consumes or stores the result within it."""
    _OPEN.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for uri in _OPEN.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(conf).delete(path, True)


def task_slots(spark: SparkSession) -> int:
    """Tasks that can run at once, the most that a barrier stage may have; 0 where executors come and
    go, as Spark has no barrier stages there."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (as ``--py-files`` does), once per context;
    a driver that found it by its working folder or ``sys.path`` alone would leave them without."""
    sc = spark.sparkContext
    if getattr(sc, "_panelstats_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="panelstats-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc.addPyFile(shutil.make_archive(f"{folder}/panelstats", "zip", root, "panelstats"))
    sc._panelstats_shipped = True


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a path of the shared folder, and the path within it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table as Parquet to the shared folder and read it back: cuts the lineage,
    survives lost executors, and lets every reader prune columns and push filters."""
    path = shared_path(df.sparkSession, "tables", purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Payload of a table: 16 bytes a row and 8 a column, and the length of its texts."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields
             if isinstance(f.dataType, (StringType, BinaryType))]
    lists = [F.greatest(F.size(f.name), F.lit(0)) * F.lit(8) for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    row = F.lit(16 + 8 * len(df.columns))
    for x in texts + lists:
        row = row + x
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small_table(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """A derived table, written once, and whether its measured bytes allow a broadcast; the
    caller lets Spark shuffle-join it otherwise."""
    if limit is None:
        limit = conf_int(df.sparkSession, "panelstats.broadcast.maxBytes", BROADCAST_BYTE_LIMIT)
    table = written(df, "small")
    return table, measured_bytes(table) <= limit


SPREAD_BYTES = 1 << 30  # estimated size up to which a table is dealt to the cores


def spread_rows(df: DataFrame) -> DataFrame:
    """Give CPU-heavy stages (model fitting, Python attribution) at least one task per core where
    byte-based sizing would pack a small but expensive table into one.  Round-robin, so a hot
    key cannot skew it; a table that the optimiser estimates beyond ``SPREAD_BYTES`` has tasks
    enough and stays as it is."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimate <= SPREAD_BYTES else df


def maybe_broadcast(df: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(df) if is_small else df

