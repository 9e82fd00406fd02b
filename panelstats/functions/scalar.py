"""Scalar helpers (X9, X10 formatting)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(c: str | Column) -> Column:
    """Log-odds -> probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def format_fixed(c: str | Column, decimals: int = 2) -> Column:
    """Python's ``{x:.2f}``."""
    return F.format_string(f"%.{decimals}f", _col(c))


def format_percent(c: str | Column, decimals: int = 2) -> Column:
    """Python's ``{x:.2%}``: value x 100, fixed decimals, a percent sign."""
    return F.format_string(f"%.{decimals}f%%", _col(c) * F.lit(100.0))
