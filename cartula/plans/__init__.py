"""Queries and whole pipelines."""
