"""Structured Streaming variants of batch operators."""

from blotter.streaming.counts import hourly_counts, incident_stream, run_to_table

__all__ = ["incident_stream", "hourly_counts", "run_to_table"]
