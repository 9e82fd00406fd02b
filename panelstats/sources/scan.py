"""Reading, typing and writing tables.

Spreadsheets are exported to CSV or Parquet before they reach Spark; mixed score columns
are read as text with an explicit schema (no inference) and typed by expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from panelstats.functions.repair import nan_to_null, repair_date_score, to_double


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "parquet", header: bool = True) -> DataFrame:
    """Scan a table with an explicit schema when given.

    Parquet keeps its own schema; CSV is never inferred: give ``schema``.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def typed_scores(df: DataFrame, score_cols: Sequence[str], repair_dates: bool = False) -> DataFrame:
    """Cast score columns to double; NaN and unparsable cells become NULL.

    With ``repair_dates`` a cell that is a date is read back as ``day.month`` (X1).
    """
    scores = set(score_cols)
    out = []
    for f in df.schema.fields:
        if f.name not in scores:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, NumericType):
            out.append(nan_to_null(F.col(f.name).cast("double")).alias(f.name))
        else:
            fn = repair_date_score if repair_dates else to_double
            out.append(fn(f.name).alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), **options) -> str:
    """Write (overwrite) a processed table (S3); returns the path."""
    w = df.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def rows_table(spark: SparkSession, rows: Sequence[dict] | Sequence[tuple],
               schema: StructType | str) -> DataFrame:
    """A few literal rows as a table, e.g. one set of form inputs."""
    return spark.createDataFrame(list(rows), schema)


# Spark type -> the dtype name ``df.info()`` prints for it
_PANDAS_DTYPE = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
                 "double": "float64", "float": "float32", "string": "object", "boolean": "bool",
                 "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "object"}


def column_profile(df: DataFrame) -> DataFrame:
    """``df.info()``: per column its position, dtype and non-NULL count, in one pass.

    Output ``(position, column, dtype, non_null, rows)``; ``dtype`` is the name pandas
    prints (so it does not depend on how a session types timestamps).
    """
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(c)).alias(f"_nn{i}")
                                                 for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    cells = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(_PANDAS_DTYPE.get(f.dataType.simpleString(), f.dataType.simpleString())).alias("dtype"),
                      F.col(f"_nn{i}").alias("non_null"))
             for i, f in enumerate(df.schema.fields)]
    return wide.select(F.explode(F.array(*cells)).alias("r"), F.col("_rows").alias("rows")).select(
        "r.*", "rows")
