"""Operators for training-data pipelines: quality, duplicates, tokens, URLs, vectors, archives, benchmarks and licences."""
