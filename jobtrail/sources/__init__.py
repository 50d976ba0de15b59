"""Scans and sinks."""

from jobtrail.sources.tables import (  # noqa: F401
    cycle_sources,
    list_sources,
    scan_postings,
    read_replies,
    read_robots,
    read_snapshots,
    read_sources,
    read_table,
    stream_snapshots,
    write_digest,
    write_postings,
    write_sources,
)
