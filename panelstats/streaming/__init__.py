"""Incremental ingest of assessment exports with Structured Streaming.

The reference has no streaming operator (no watermark, window or state): its inputs are
bounded spreadsheets.  The one step that naturally runs incrementally is its ingest —
read a new export, repair and type the scores, append to the processed table — and that
is all this module does, with the same expressions as the batch path.
"""

from panelstats.streaming.ingest import start_repair_ingest

__all__ = ["start_repair_ingest"]
