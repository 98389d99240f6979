"""Incremental ingest with Structured Streaming: an extension, batch runs do not need it."""
