"""Operators for preparing training corpora: deduplication, filtering, mixing, tokenising, sharding, search."""
