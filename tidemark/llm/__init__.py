"""Operators for building training corpora: scoring, filtering, deduplication, tokenising and packing.

Every module holds one operator with its own general interface; ``registry`` derives the registered queries.
Nothing else in the library imports this package.
"""
