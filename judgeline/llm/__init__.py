"""Operators for training-data pipelines: deduplication, filters, tokens, mixing and scoring."""
