"""Operators of a training-data pipeline: packing, quality, tokens, dedup, shards, pages and pieces."""
