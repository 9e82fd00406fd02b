"""Column expressions: all built-in Spark functions, so they stay inside codegen."""

from panelstats.functions.repair import nan_to_null, repair_date_score, to_double
from panelstats.functions.labels import (binary_label, ordinal_label, prediction_rgb,
                                         prediction_text)
from panelstats.functions.scalar import format_percent, format_fixed, sigmoid

__all__ = ["nan_to_null", "repair_date_score", "to_double", "binary_label", "ordinal_label",
           "prediction_rgb", "prediction_text", "format_percent", "format_fixed", "sigmoid"]
