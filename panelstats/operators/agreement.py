"""Rater disagreement over time (R2, O1, with A4, W2, J6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.operators.profile import first_row


def first_visit(df: DataFrame, point: str, date: str, seq: str, date_col: str = "visit_date") -> DataFrame:
    """Date (``to_date``) of the first row of every point, by ``seq``."""
    first = first_row(df.select(point, date, seq), [point], seq)
    return first.select(point, F.to_date(F.col(date)).alias(date_col))


def disagreement_over_time(sd_profile: DataFrame, visits: DataFrame, point: str,
                           sd_cols: Sequence[str] | None = None, score_col: str = "score",
                           sd_col: str = "sd", date_col: str = "visit_date",
                           long_by: str | None = None) -> DataFrame:
    """``(point, date, score, sd)`` series, newest first (R2).

    ``sd_profile`` has one row per point with ``<score>_sd`` columns (then ``sd_cols``
    names them and they are unpivoted), or one row per (point, ``long_by``) with a single
    ``sd`` column already long.  The visit date comes from an inner join on the point
    (J6), so points without a first visit drop, as in the source.
    """
    if long_by is None:
        long = sd_profile.unpivot([point], list(sd_cols), score_col, sd_col)
    else:
        long = sd_profile.select(point, F.col(long_by).alias(score_col), F.col(sd_cols[0]).alias(sd_col))
    return (long.join(visits.select(point, date_col), [point], "inner")
                .select(point, date_col, score_col, sd_col)
                .orderBy(F.desc(date_col), F.asc(point), F.asc(score_col)))
