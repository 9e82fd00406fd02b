"""Streaming form of read -> repair -> write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelstats.sources.scan import typed_scores


def start_repair_ingest(spark: SparkSession, source_dir: str, schema: StructType | str,
                        score_cols: Sequence[str], sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                        available_now: bool = True) -> StreamingQuery:
    """Watch ``source_dir`` for new export files; repair and type the scores of every new
    file and append them to ``sink_dir`` (Parquet).

    Stateless, so every micro-batch is independent.  ``checkpoint_dir`` belongs to the sink: the
    same folder must be given at every restart, and files are then taken exactly once.
    ``available_now`` processes what is there and stops (a scheduled job); otherwise the
    query keeps running.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = reader.load(source_dir)
    typed = typed_scores(raw, score_cols, repair_dates=True)
    writer = (typed.writeStream.format("parquet").outputMode("append")
                   .option("path", sink_dir)
                   .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
