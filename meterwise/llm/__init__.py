"""Operators that prepare training text: cleaning, deduplication, mixing, sharding, formatting."""
