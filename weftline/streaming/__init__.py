"""Incremental reading and writing."""
