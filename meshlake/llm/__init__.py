"""Training-data operators: quality, deduplication, mixing, sharding, tokens.

Nothing outside this subpackage imports it.
"""
