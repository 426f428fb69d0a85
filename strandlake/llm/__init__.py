"""Operators for large text corpora: retrieval, tokenisation, deduplication, packing, scoring.

Nothing outside this package imports it; ``queries.py`` lists its queries.
"""
