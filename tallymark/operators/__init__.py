"""Operators over DataFrames: exact counts, sketches, merges and statistics."""
