"""Ingest: batches, upserts, deletes, compaction and streams."""
