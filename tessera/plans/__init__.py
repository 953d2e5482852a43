"""Whole plans: hybrid search from queries to cut results."""
