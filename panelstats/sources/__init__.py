"""Typed scans, writes, literal rows, schema profile and model persistence."""

from panelstats.sources.scan import (column_profile, read_table, rows_table, typed_scores,
                                     write_table)

__all__ = ["column_profile", "read_table", "rows_table", "typed_scores", "write_table"]
