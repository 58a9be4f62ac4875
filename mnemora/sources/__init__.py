"""Readers and writers: node files, chain manifests, JSON-lines logs and the parquet tables."""
