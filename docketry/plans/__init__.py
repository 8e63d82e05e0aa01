"""Serving queries and the query registry."""
