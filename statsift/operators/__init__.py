"""Operators over DataFrames keyed by ``source_id``."""
