"""Structured Streaming forms of the incremental patterns; the same functions take batch DataFrames."""
