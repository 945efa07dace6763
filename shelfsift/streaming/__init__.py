"""Incremental forms of indexing and scoring."""
