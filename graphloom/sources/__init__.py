"""Readers that turn files into fact tables, and writers of graph tables."""
