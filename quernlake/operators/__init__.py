"""Shredding, index building, evaluation and row filtering."""
