"""Incremental jobs over folders of new files."""
