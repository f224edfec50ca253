"""Readers and writers for corpora, lexicons, datasets, run records and reports."""
