"""Operators for preparing training data: copies, mixtures, quality, search, shards and leaks."""
