"""Structured Streaming counterparts of the batch jobs."""
