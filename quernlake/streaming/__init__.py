"""Incremental indexing of document streams."""
