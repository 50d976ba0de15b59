"""Incremental cycles over newly landed snapshots."""

from jobtrail.streaming.stream import process_batch, stream_cycle  # noqa: F401
