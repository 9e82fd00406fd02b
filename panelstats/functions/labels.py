"""Class label encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelstats import constants as K


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary_label(c: str | Column, negatives: Sequence[str] = K.NEGATIVE_CLASSES,
                 missing_is_positive: bool = True) -> Column:
    """1 unless the class is one of ``negatives``.

    A missing class is *positive* by default, as ``~isin`` on a NaN gives in pandas;
    with ``missing_is_positive=False`` it stays NULL.
    """
    member = _col(c).isin(list(negatives))
    if missing_is_positive:
        member = F.coalesce(member, F.lit(False))
    return F.when(member, F.lit(0)).when(~member, F.lit(1)).cast("int")


def ordinal_label(c: str | Column, order: Sequence[str] = K.CLASS_ORDER) -> Column:
    """Position of the class in ``order`` (0-based); unknown or missing -> NULL."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), _col(c))
    return F.when(pos > 0, pos - 1).cast("int")


def prediction_text(c: str | Column, text: Mapping[int, str] = K.PREDICTION_TEXT) -> Column:
    out = None
    for k, v in text.items():
        out = (F.when(_col(c) == k, F.lit(v)) if out is None
               else out.when(_col(c) == k, F.lit(v)))
    return out


def prediction_rgb(c: str | Column, colours: Mapping[int, Sequence[int]] = K.PREDICTION_RGB) -> Column:
    out = None
    for k, rgb in colours.items():
        arr = F.array(*[F.lit(int(x)) for x in rgb])
        out = F.when(_col(c) == k, arr) if out is None else out.when(_col(c) == k, arr)
    return out
