"""Operators for building training corpora: search, filtering, deduplication, mixing and packing."""
