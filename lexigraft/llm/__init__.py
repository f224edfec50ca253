"""Operators for large training corpora: tokenization, filtering, deduplication, mixing."""
