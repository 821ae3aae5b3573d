"""Composite jobs: whole workflows assembled from the operators."""
