"""Operators of a training-data pipeline: quality, toxicity, deduplication, PII, packing, sharding, search."""
