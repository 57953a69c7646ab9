"""Operators for preparing training data: deduplication, text repair, packing, mixing, redaction."""
