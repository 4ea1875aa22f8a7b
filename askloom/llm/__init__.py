"""Operators for preparing training data: search, packing, deduplication, filters, tokens."""
