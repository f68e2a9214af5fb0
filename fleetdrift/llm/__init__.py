"""Operators of a training-data pipeline: counting, encoding, packing, deduplication, filtering and sharding of texts."""
