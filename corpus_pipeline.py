"""A training-data pipeline over ``documents``: five stages, each one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
``documents``.

Defined cases, in every stage: an empty table gives an empty table; NULL and empty texts have no
words, no lines to lose and no windows, so they stay; NULL ids and sources are values like any
other (NULL ids come last where the earliest counts); columns of ``docs`` beyond those of
``documents`` are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from panelstats.llm.common import scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is below the threshold.  Repeated rows are judged
    alike; without labels of both kinds nothing is toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; documents of nothing else go.  n_chars follows.  Of equal
    lines the one of the least id and line number stays; rows that repeat an id come out alike."""
    out = line_dedup.drop_duplicate_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = out.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, that of the least id; rows that repeat an id
    with its text count as one."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; an empty benchmark finds none.  Equal texts have
    equal verdicts."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, placed by mix_position.  Rows with equal ids have an order fixed by a hash of
    the row."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# The fitted model, edit distances and shingle similarities have no SQL; the stages are
# tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scratch(spark):  # what a stage has written on its way goes with the stage
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
