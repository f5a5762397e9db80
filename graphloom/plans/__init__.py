"""Iteration over DataFrames with lineage cut in the shared folder."""
