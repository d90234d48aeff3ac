"""Streaming variants of the loads."""
