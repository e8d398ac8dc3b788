"""Structured Streaming plans. An extension: incremental upkeep of what the batch operators compute."""
