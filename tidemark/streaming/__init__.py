"""Structured Streaming: sample-file ingest and watermarked window aggregates,
both landing in ledger tables through idempotent per-batch commits."""
