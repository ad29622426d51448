"""Operators for preparing training text: dedup, filters, mixing and tokens."""
