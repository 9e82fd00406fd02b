"""Thematic map table: every scored point with position, class text, colour and the map
centre (M19, X8, A8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats import constants as K
from panelstats.functions.labels import prediction_rgb, prediction_text
from panelstats.session import written


def thematic_table(scored: DataFrame, geo: DataFrame, key: str, lat: str = "lat", lon: str = "lon",
                   prediction: str = "prediction", text: Mapping[int, str] = K.PREDICTION_TEXT,
                   colours: Mapping[int, Sequence[int]] = K.PREDICTION_RGB, name: str | None = None) -> DataFrame:
    """``(key, [name], lat, lon, prediction, prediction_class, color, center_lat, center_lon)``.

    ``name`` is the point's name in ``geo`` (the map's tooltip shows it).  The centre is the
    mean position over all mapped points: a two-number aggregate, read once on the driver
    from the written join and added as literals.
    """
    shown = [name] if name else []
    mapped = written(scored.select(key, prediction).join(geo.select(key, *shown, lat, lon), [key], "inner"), "map")
    centre = mapped.agg(F.avg(lat).alias("a"), F.avg(lon).alias("b")).first()
    return mapped.select(key, *shown, lat, lon, F.col(prediction),
                         prediction_text(prediction, text).alias("prediction_class"),
                         prediction_rgb(prediction, colours).alias("color"),
                         F.lit(centre["a"]).cast("double").alias("center_lat"),
                         F.lit(centre["b"]).cast("double").alias("center_lon"))
