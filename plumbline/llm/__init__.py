"""Operators for training-data pipelines: counting, mixing, packing, deduplication, quality,
language, nearest neighbours, chat formatting and fingerprints."""
