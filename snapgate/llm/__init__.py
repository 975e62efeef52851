"""Operators for building training corpora: sharding, mixing, deduplication, filtering."""
