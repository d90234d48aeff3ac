"""Analytical queries over the warehouse."""
