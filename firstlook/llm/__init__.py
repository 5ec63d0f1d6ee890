"""Operators for preparing training text: deduplication, scoring, search, packing, filtering and tokens."""
