"""Structured Streaming counterparts of the batch upserts."""
