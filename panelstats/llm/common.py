"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A derived table is broadcast only when its measured payload is below this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, a laptop) gets a private folder that goes
    with the process; a cluster session gets an error, because a folder of the driver's
    machine would not reach its executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="panelstats-shared-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return (spark.sparkContext.getCheckpointDir() or root).rstrip("/")


_OPEN: list[list[str]] = []  # paths handed out within the open scratch blocks


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark)}/panelstats-{purpose}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within the block go when it ends: for a caller that writes the
    result within it, under a path taken before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for uri in _OPEN.pop():
            store, path = filesystem(uri)
            if store.get_file_info(path).type.name == "Directory":
                store.delete_dir(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a path of the shared folder, and the path within it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a small file whole: under a temporary name, then renamed."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.tmp") as out:
        out.write(data)
    store.move(f"{path}.tmp", path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost
    executors, and lets several consumers read pruned columns."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, n_bytes: int) -> DataFrame:
    """Broadcast hint behind a check of the measured size; Spark shuffles it otherwise."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when ``body`` refers to it
    inside a lambda (a plain column reference there would be inlined and computed per element)."""
    return F.transform(F.array(value), body)[0]


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
