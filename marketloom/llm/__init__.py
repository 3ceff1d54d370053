"""Operators for building training corpora: sharding, scoring, search, dedup, packing."""
