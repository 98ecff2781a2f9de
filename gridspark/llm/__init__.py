"""Operators for large text corpora: deduplication, search, sharding, mixing, tokens, quality, language."""
