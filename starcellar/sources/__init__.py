"""Readers, writers and the load log."""
