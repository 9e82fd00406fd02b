"""Column resolution and projection.

Column lists are resolved once on the driver from ``df.columns`` (schema metadata only),
then handed to ``select``/``drop`` so Catalyst prunes the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelstats import constants as K


def score_columns(df: DataFrame, exclude: Sequence[str] = K.ID_COLUMNS) -> list[str]:
    """Every column not in ``exclude``."""
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def select_scores(df: DataFrame, exclude: Sequence[str] = K.ID_COLUMNS,
                  keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns followed by every score column."""
    keep = list(keep)
    return df.select(*keep, *[c for c in score_columns(df, exclude) if c not in keep])


def matching_columns(df: DataFrame, patterns: Sequence[str], how: str = "contains") -> list[str]:
    """Names matching any pattern, case-sensitively.

    ``how="contains"`` matches anywhere in the name, as the source's substring rules do
    (so ``admin_mean`` matches ``"min"``); ``"suffix"`` only at the end.
    """
    if how == "contains":
        return [c for c in df.columns if any(p in c for p in patterns)]
    if how == "suffix":
        return [c for c in df.columns if any(c.endswith(p) for p in patterns)]
    raise ValueError(f"unknown match rule {how!r}")


def drop_matching(df: DataFrame, patterns: Sequence[str], how: str = "contains",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose name matches any pattern, except those in ``keep``."""
    protect = set(keep)
    return df.drop(*[c for c in matching_columns(df, patterns, how) if c not in protect])


def columns_at(df: DataFrame, positions: Sequence[int]) -> list[str]:
    """Names at 1-based positions, as R's ``df[, c(1, 3)]`` (P5)."""
    return [df.columns[p - 1] for p in positions]


def stat_columns(names: Sequence[str], stat: str, exclude_patterns: Sequence[str] = ()) -> list[str]:
    """``<score>_<stat>`` for each score, skipping names with an excluded pattern."""
    return [f"{n}_{stat}" for n in names if not any(p in n for p in exclude_patterns)]
