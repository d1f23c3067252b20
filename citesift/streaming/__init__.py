"""Structured Streaming forms of ingest, ask and the event rollup."""
