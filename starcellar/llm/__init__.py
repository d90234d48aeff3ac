"""Operators for training data: filters, near duplicates, secrets, tokens, rankings, search."""
