"""Operators for building training data: filtering, deduplication, mixing, sharding, archives."""
