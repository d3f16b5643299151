"""Operators that prepare training data: packing, deduplication, filtering, redaction, extraction, formatting."""
