"""Operators for preparing training data: filters, deduplication, mixing, sharding, output.

Nothing else in the library imports this package.
"""
