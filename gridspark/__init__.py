"""Batch and streaming Spark jobs for gridded space-time data."""
