"""Readers and writers with lineage."""
