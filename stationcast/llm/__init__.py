"""Operators for preparing training corpora: scoring, filtering, deduplication, mixing, encoding."""
