"""Readers that turn files into DataFrames with explicit schemas and row keys."""
