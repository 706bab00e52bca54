"""Incremental refresh of graph tables."""
