"""Operators for preparing training text: filters, deduplication, mixing, packing and token files."""
