"""Operators for large text corpora: filtering, deduplication, mixing, sharding, tokenising.

Self-contained: nothing else in the library imports this subpackage.
"""
