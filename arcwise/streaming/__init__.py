"""Streaming ingest: files of events or edges become stored edges and running degrees."""
