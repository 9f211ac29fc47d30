"""Structured Streaming versions of ingestion, job state and rate limits."""
