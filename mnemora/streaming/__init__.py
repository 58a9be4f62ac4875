"""Structured Streaming entry points over the same logic as the batch operators."""
