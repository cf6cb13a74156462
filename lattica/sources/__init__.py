"""Matrices in Parquet: entries, rows and blocks."""
