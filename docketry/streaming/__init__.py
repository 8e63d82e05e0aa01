"""Incremental intake and the daily run."""
