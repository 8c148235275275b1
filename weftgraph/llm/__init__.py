"""Training-data operators: tokenising, deduplication, filtering, sharding and fingerprints.

Nothing outside this package imports it.
"""
