"""Operators of a training-data pipeline: quality, dedup, mixing, packing, formatting, encoding, toxicity, personal data.

Nothing else in the library imports this package; its queries are in `queries`.
"""
