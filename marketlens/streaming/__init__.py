"""Incremental (streaming) form of the table load."""
