"""Operators for preparing training data: filtering, deduplication, mixing, scoring and encoding."""
