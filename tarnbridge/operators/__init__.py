"""Operators over DataFrames: comparing, checking, loading and changing tables."""
