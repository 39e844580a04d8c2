"""Operators of a training-data pipeline: filters, near-duplicate search, archives, tokens, packing."""
