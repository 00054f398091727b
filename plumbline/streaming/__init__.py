"""Structured Streaming forms of the detector and of ingest."""
