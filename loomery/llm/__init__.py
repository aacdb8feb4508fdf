"""Operators for large text corpora: deduplication, packing, scoring, mixing, archives."""
