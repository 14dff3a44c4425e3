"""Readers and writers: registered Parquet sources, nested JSON, and sinks with slice, upsert and snapshot semantics."""
