"""Structured Streaming jobs of the digest pipeline (queue worker, gate,
fan-out, feed ingest).  Sinks are parquet tables; every query has its own
checkpoint under the shared checkpoint folder."""
