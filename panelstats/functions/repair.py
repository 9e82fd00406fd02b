"""Typing and repair of score cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL, so that avg/min/max/count skip it as pandas and ``na.rm`` do."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


# What counts as a number (a plain decimal, with or without an exponent) and as a date that a
# spreadsheet wrote (a full date, with or without a time).  Casts alone accept more: "7d",
# "0x1p3" and "Infinity" as numbers, "12:30" as a time of the current day, "2024-3" as a date.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$"


def _number(s: Column) -> Column:
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def _date(s: Column) -> Column:
    return F.when(s.rlike(DATE), F.substring(F.trim(s), 1, 10).try_cast("date"))


def to_double(c: str | Column) -> Column:
    """Total cast to double: unparsable text and NaN become NULL (ANSI-safe)."""
    return nan_to_null(_col(c).cast("string").try_cast("double"))


def repair_date_score(c: str | Column) -> Column:
    """A score that a spreadsheet turned into a date is read back as ``day.month``.

    The number is tried first, so plain decimals (``"5.3"``) and integers pass through; only
    cells that hold a full date are rebuilt from its day and month (5 March -> 5.3; 5 January
    and 5 October both -> 5.1, as in the source).  Anything else, and missing cells, become
    NULL.
    """
    s = _col(c).cast("string")
    day = _date(s)
    from_date = F.concat_ws(".", F.dayofmonth(day).cast("string"), F.month(day).cast("string")).try_cast("double")
    return F.coalesce(_number(s), F.when(day.isNotNull(), from_date))


def was_date_repaired(c: str | Column) -> Column:
    """True where :func:`repair_date_score` rebuilt the value from a date."""
    s = _col(c).cast("string")
    return _number(s).isNull() & _date(s).isNotNull()
