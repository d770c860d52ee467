"""Operators for building training text: deduplication, scoring, mixing, token files."""
