"""Queries and virtual corpora."""
