"""Tiered fuzzy search over DataFrames."""
