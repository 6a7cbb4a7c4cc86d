"""Registered queries: surrogate views over the star tables, and their SQL."""
