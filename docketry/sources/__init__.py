"""Readers, page ingest and sample views."""
