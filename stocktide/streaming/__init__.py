"""Incremental ingest."""

from stocktide.streaming.ingest import ingest_daily, pack_ingested, read_ingested, read_packed  # noqa: F401
